"""Chat rendering after collapsing cumulative snapshots, with built-in functions only.

Chat logs often store a conversation again after each turn, so one log is a prefix of a longer one. Rolling hashes of the turn
prefixes find those: a conversation whose last rolling hash is a proper-prefix hash of some longer conversation is dropped by
an anti-join; of conversations with equal turns the smallest id stays. What is left is rendered with role headers.

Prefix hashes are made distinct before the join, so a first turn that a third of all conversations share is one key with one
row on the build side. A turn's hash is 120 bits of the SHA-256 of its place, role and text; that of a prefix is the exclusive or of
its turns' hashes, which a window rolls on from turn to turn in one pass. Prefixes of equal length and hash are taken as equal.

Defined results: turns are ordered by (turn, role, text) with nulls first; repeated (turn, role, text) rows count once; a null
role or text is rendered as empty, and counts as different from an empty one. Rows without a conv_id belong to no known conversation:
each different (role, text) of them is a conversation of one turn with a null id, so that they never gather in one place. A text or
role that has the marks of a role header, ``<|`` or ``|>``, is rendered with a backslash after the mark's first character, so no
message can pass for a turn. An empty table gives no rows. Columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def turn_hashes(place: Column) -> list[Column]:
    """Two numbers of 60 bits for a turn at a place."""
    digest = F.sha2(F.concat(place.cast("string"), F.coalesce(F.concat(F.lit("r"), "role"), F.lit("n")), F.lit("\x01"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("n"))), 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16)]


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, last, a, b): every turn with its place, whether it is the last, and the hash of the turns up to it."""
    columns = conversations.select("conv_id", "turn", "role", "text")
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    again = reduce(Column.__and__, (F.lag(c).over(by).eqNullSafe(F.col(c)) for c in ("turn", "role", "text")))
    named = columns.where("conv_id is not null").withColumn("again", again & (F.row_number().over(by) > 1)).where("not again").drop("again")
    named = named.withColumn("n", F.row_number().over(by)).withColumn("last", F.lead("n").over(by).isNull())
    up_to = by.rowsBetween(Window.unboundedPreceding, 0)
    own = named.select("*", *(h.alias(x) for h, x in zip(turn_hashes(F.col("n")), "ab", strict=True)))
    named = own.select("conv_id", "turn", "role", "text", "n", "last", *(F.bit_xor(x).over(up_to).alias(x) for x in "ab"))
    alone = columns.where("conv_id is null").groupBy("conv_id", "role", "text").agg(F.min("turn").alias("turn")).withColumn("n", F.lit(1))
    alone = alone.select("conv_id", "turn", "role", "text", "n", F.lit(True).alias("last"), *(h.alias(x) for h, x in zip(turn_hashes(F.col("n")), "ab", strict=True)))
    return named.unionByName(alone)


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the maximal conversations, each with its sorted turns; of those with equal turns the least conv_id."""
    turns = prefixes(conversations)
    proper = turns.where("not last").select("n", "a", "b").distinct()
    whole = turns.where("last").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    keep = whole.join(proper, ["n", "a", "b"], "left_anti")
    named = turns.join(keep.where("conv_id is not null").select("conv_id"), "conv_id", "left_semi")
    named = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("turns"))
    alone = turns.where("conv_id is null").join(keep.where("conv_id is null").select("n", "a", "b"), ["n", "a", "b"], "left_semi")
    return named.unionByName(alone.select("conv_id", F.array(F.struct("n", "role", "text")).alias("turns")))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit("<|"), _plain(x["role"]), F.lit("|>\n"), _plain(x["text"]))), "\n")


def chat_format(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of every maximal conversation."""
    kept = collapse(conversations)
    return kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("rendered"))

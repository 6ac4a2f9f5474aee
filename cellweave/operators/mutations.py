"""Puts and deletes as rows of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

NO_VALUE = "a put needs a value"


def puts(rows: DataFrame) -> DataFrame:
    """Mutations that write; rows with partition_key, clustering_key, column_name, value."""
    return rows.select("partition_key", "clustering_key", "column_name", "value", F.lit(False).alias("is_tombstone"))


def deletes(keys: DataFrame) -> DataFrame:
    """Mutations that delete; a key that was never written may be deleted, and its tombstone is stored."""
    return keys.select("partition_key", "clustering_key", "column_name", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("is_tombstone"))


def checked(mutations: DataFrame) -> DataFrame:
    """Fails in the job that reads it if a put has no value or an empty one; so no job of its own is spent on the question."""
    bad = ~F.col("is_tombstone") & (F.coalesce(F.octet_length("value"), F.lit(0)) == 0)
    return mutations.withColumn("value", F.when(bad, F.raise_error(F.lit(NO_VALUE)).cast("binary")).otherwise(F.col("value")))


def placed(rows: DataFrame, order: Column, ties: list, name: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by ranges of the order, sorted, with (range << 33) + place in the range as ``name``.

    Equal orders are told apart by ``ties``, so no range takes all rows of one. The number of ranges is ``parts``, or else that of
    the shuffle partitions, of which Spark joins small ones. One shuffle; write the result before the places are used.
    """
    by = [F.col("__o"), *ties]
    ranged = rows.withColumn("__o", order).repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    return ranged.withColumn(name, F.monotonically_increasing_id()).drop("__o")


def with_sequence(rows: DataFrame, order: Column, base: int = 1, parts: int | None = None, ties: list | None = None) -> DataFrame:
    """Gap-free sequence numbers in the given order, without bringing all rows to one task.

    The placed rows are written to the shared folder, and the sizes of their ranges are counted there: borders and numbers come
    from the same rows, whatever tasks are repeated. ``ties`` decide between equal orders: all other columns that can be
    ordered, if not given; rows that are equal in those too are the same.
    """
    by = ties if ties is not None else [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"]
    kept = stored(placed(rows, order, by, "__at", parts), "placed")
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__p")).count().orderBy("__p").collect()  # one row a range, of which there are as many as shuffle partitions
    before, n = {}, 0
    for r in sizes:
        before[r["__p"]], n = n, n + r["count"]
    starts = F.from_json(F.lit("[" + ",".join(str(before.get(p, 0)) for p in range(max(before, default=0) + 1)) + "]"), "array<bigint>")
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("sequence", (F.lit(base) + F.get(starts, part.cast("int")) + place).cast("bigint")).drop("__at")


def next_sequence(run_max: int, log_max: int | None) -> int:
    """The next number to give out after a start: past everything stored, with a gap of one if a log was replayed."""
    return run_max + 1 if log_max is None else max(run_max + 1, log_max) + 1

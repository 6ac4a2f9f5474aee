"""Line-first quality cleaning with built-in functions only.

Every line is judged by itself (symbols, shouting, navigation bars and labels without closing punctuation, a few words over and
over, boilerplate); failing lines are removed, and a document that loses too much of its text is rejected. A rule on words looks at
a bounded neighbourhood of each, so a line of a million words is judged as a line of twenty. All work is local to a row: no shuffle.

Defined results: null and empty texts have no words, fail the base rule and give an empty ``clean_text``; repeated rows are
judged one by one; other columns of the input are carried through untouched (columns named like a result are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = r"(?i)(licensed under the|all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|copyright \(c\)|subscribe to our newsletter)"


def _windows(words: Column) -> Column:
    """64-bit hashes of all 3-word windows, in order; ``words`` must be a plain column (it is used several times)."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 3, grams).otherwise(F.array().cast("array<bigint>"))


def _sorted(grams: Column) -> Column:
    """Windows with their starts, sorted: equal windows become neighbours."""
    return F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))


def _starts(order: Column) -> Column:
    def twin(x: Column, j: Column) -> Column:
        before = (j > 0) & (F.get(order, j - 1)["g"] == x["g"])
        after = (j < F.size(order) - 1) & (F.get(order, j + 1)["g"] == x["g"])
        return before | after

    return F.sort_array(F.transform(F.filter(order, twin), lambda x: x["i"]))


def _count(starts: Column) -> Column:
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(3), s - a["last"])).alias("n")), lambda a: a["n"])


#: One of these is in the lower-cased text of every document with a boilerplate line.
HINTS = ("licensed under", "all rights", "terms of", "privacy policy", "cookies", "enable javascript", "copyright (c)", "our newsletter")


#: A word that closes a sentence, maybe with quotes or brackets after its mark.
CLOSED = r"[.!?…:;。！？]['\"”’»)\]]*$"
#: Most words of a navigation label; words before a word that make it a repeated one.
LABEL, NEAR = 3, 8


def _stuck(words: Column) -> Column:
    """Ten words or more, of which over three quarters stand among the eight words before them.

    Such a line has fewer different words than a quarter; that is asked first, as it takes one step.
    """
    n = F.size(words)
    stale = F.filter(F.sequence(F.lit(2), n), lambda i: F.array_contains(F.slice(words, F.greatest(F.lit(1), i - NEAR), F.least(i - 1, F.lit(NEAR))), F.get(words, i - 1)))
    return (n >= 10) & (4 * F.size(F.array_distinct(words)) < n) & (4 * F.size(stale) > 3 * n)


def line_fails(line: Column, words: Column, flags: dict[str, Column]) -> Column:
    """True for lines that are symbol noise, shouting, navigation, an unfinished label, stuck words, or boilerplate.

    flags: of the whole document; a rule whose flag is false can't hit any of its lines.
    """
    n = F.size(words)
    symbols = 10 * F.regexp_count(line, F.lit(SYMBOLS)) > F.length(F.array_join(words, ""))
    shouting = (n >= 3) & (2 * F.regexp_count(line, F.lit(r"!!")) > n)
    navigation = (F.regexp_count(line, F.lit(r" \| ")) >= 3) | ((n >= 4) & (2 * F.regexp_count(line, F.lit(r"[»›•|]")) > n))
    label = (n >= 1) & (n <= LABEL) & ~F.element_at(words, -1).rlike(CLOSED)
    return (flags["symbols"] & symbols) | (flags["shouting"] & shouting) | (flags["navigation"] & navigation) | label | _stuck(words) | (flags["boilerplate"] & line.rlike(BOILERPLATE))


def quality_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat: int = 50, min_left: int = 50) -> DataFrame:
    """Adds the counts, ``base_failed``, ``clean_text``, ``n_lines_removed`` and ``kept`` to every row.

    min_words: fewest words; max_repeat: largest percentage of words under repeated 3-word windows; min_left: least percentage
    of the characters of lines that must be left after the failing lines are removed.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    carried = [c for c in docs.columns if c not in OUTPUT]
    step = docs.select(*carried, t.alias("__t"))
    lines = F.transform(F.split("__t", "\n"), lambda x: F.struct(x.alias("x"), F.array_remove(F.split(x, SPACE + "+"), "").alias("w")))
    step = step.select(*carried, "__t", lines.alias("__l"), F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.lower("__t").alias("__b"))
    step = step.withColumn("__w", F.flatten(F.col("__l.w")))
    hints = F.col("__b").contains(HINTS[0])
    for h in HINTS[1:]:
        hints = hints | F.col("__b").contains(h)
    bars = F.col("__t").contains("|") | F.col("__t").contains("»") | F.col("__t").contains("›") | F.col("__t").contains("•")
    flags = {"symbols": F.col("n_symbols") > 0, "shouting": F.col("__t").contains("!!"), "navigation": bars, "boilerplate": hints}
    step = step.select(*carried, "__t", "__l", "__w", "n_symbols", *(c.alias(f"__{k}") for k, c in flags.items()), _windows(F.col("__w")).alias("__g"))
    step = step.withColumn("__some", F.size(F.array_distinct("__g")) < F.size("__g"))
    step = step.withColumn("__o", F.when(F.col("__some"), _sorted(F.col("__g"))))
    step = step.withColumn("__s", F.when(F.col("__some"), _starts(F.col("__o"))))
    step = step.withColumn("__full", F.filter("__l", lambda x: F.size(x["w"]) > 0)["x"])
    step = step.withColumn("__good", F.filter("__l", lambda x: ~line_fails(x["x"], x["w"], {k: F.col(f"__{k}") for k in flags}))["x"])
    total = lambda c: F.length(F.array_join(c, ""))
    step = step.select(
        *carried,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("__full") - F.size(F.array_distinct("__full"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_count(F.col("__s")), F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.size("__l") - F.size("__good")).cast("long").alias("n_lines_removed"),
        total(F.col("__l.x")).cast("long").alias("line_chars"),
        total(F.col("__good")).cast("long").alias("left_chars"),
        F.array_join("__good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    step = step.withColumn("base_failed", failed)
    # the partition number keeps filters on the verdict above this projection: pushed below, they would be written out anew
    # for each column that they rest on, and the condition would grow without bound
    verdict = ~F.col("base_failed") & (100 * F.col("left_chars") >= min_left * F.col("line_chars"))
    return step.withColumn("kept", verdict & (F.spark_partition_id() >= 0))


OUTPUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "line_chars", "left_chars", "clean_text", "base_failed", "kept")

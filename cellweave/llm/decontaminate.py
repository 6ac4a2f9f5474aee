"""Benchmark decontamination by a positional inverted index, with built-in functions only.

Test items are cut into windows of ``size`` consecutive words. One pass over the corpus counts every test term; a window with an
absent term cannot occur. Of each other window the rarest term is its anchor. A second pass stores the postings of the anchors:
(term, document, position) with the words around the position. Those are the entries of the other terms' lists that an
offset-adjusted intersection can reach from there, kept beside the posting that needs them: the lists of common terms, most of
the corpus, are never stored, shuffled or merged. An exact phrase match probes them at the offsets of the window, starting from
the anchor; a proximity match asks for all words of the window in the neighbourhood, in any order. The same pass notes the
number of words of each document.

Common words are never anchors unless a window has nothing rarer, so the stored table follows the matches, not the corpus.
Windows and test terms are broadcast only while their counted rows stay below a limit; beyond, the joins shuffle on the term.

Defined results: a null text has no words and no hits; null or wordless items have no window; equal windows of several items
count for each; repeated documents are judged alike; item ids are compared as strings; null ids of items are ignored; other
columns are not read. A document row is identified by (doc_id, hash of its text), so a null or repeated doc_id is harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, small, stored, tokens

#: Words that may stand among those of a window that is near.
SLACK = 2

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return tokens(ascii_lower(text), BETWEEN)


def test_windows(items: DataFrame, size: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, items): the distinct windows with the sorted ids of the items that have them."""
    w = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    cut = w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def term_counts(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): occurrences in the whole corpus of every test term that occurs."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    found = docs.select(F.explode(words_of(F.col(text))).alias("term"))
    return found.join(small(terms, terms.count()), "term").groupBy("term").agg(F.count("*").alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, items, anchor, at): the rarest term of each window that can occur and its place in the window."""
    terms = windows.select("words", F.posexplode("words").alias("at", "term"))
    known = terms.join(counts, "term", "left")
    best = known.groupBy("words").agg(F.count("n").alias("have"), F.min(F.struct("n", "at", "term")).alias("a")).where(F.col("have") == F.size("words"))
    return windows.join(best, "words").select("words", "items", F.col("a.term").alias("anchor"), F.col("a.at").alias("at"))


def postings(docs: DataFrame, anchors: DataFrame, reach: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, term, pos, left, around): one row for each occurrence of an anchor, with ``reach - 1`` words to each side,
    and one for each document row with a null term and the number of words as ``pos``."""
    terms = anchors.select(F.col("anchor").alias("__t")).distinct()
    w = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(F.col(text)).alias("w"))
    each = w.select("doc_id", "text_hash", "w", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "term"))
    n = terms.count()
    if n <= BROADCAST_ROWS:
        found = each.join(F.broadcast(terms), F.col("term") == F.col("__t"), "left").where("term is null or __t is not null")
    else:  # documents' own rows stay out of the shuffle on the term
        found = each.where("term is not null").join(terms, F.col("term") == F.col("__t")).unionByName(each.where("term is null").withColumn("__t", F.lit(None).cast("string")))
    left = F.least(F.col("pos"), F.lit(reach - 1))
    near = F.slice("w", F.col("pos") - left + 1, left + reach)
    return found.select("doc_id", "text_hash", "term", "pos", left.alias("left"), F.when(F.col("term").isNotNull(), near).alias("around"))


def phrase_matches(index: DataFrame, anchors: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text_hash, start, length, items): every exact occurrence of a window."""
    joined = index.join(small(anchors, rows), index["term"] == anchors["anchor"])
    first = F.col("left") - F.col("at")
    same = (first >= 0) & (F.slice("around", F.greatest(first, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    return joined.where(same).select("doc_id", "text_hash", (F.col("pos") - F.col("at")).alias("start"), F.size("words").alias("length"), "items")


def proximity_matches(index: DataFrame, anchors: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text_hash, pos, items): anchors around which all different words of a window stand, in any order."""
    joined = index.join(small(anchors, rows), index["term"] == anchors["anchor"])
    return joined.where(F.size(F.array_except("words", "around")) == 0).select("doc_id", "text_hash", "pos", "items")


def _covered(spans: Column) -> Column:
    """Words under the sorted (start, length) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 8, min_items: int = 2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated, n_near, near_items) for every document row.

    near_items are the items of which a window of ``size`` different words stands, in any order, within ``size + SLACK - 1`` words of
    its anchor; n_near is their number. Shorter windows and those that repeat a word are only looked for as phrases.
    """
    windows = stored(test_windows(items, size, item_id, text), "windows")
    counts = stored(term_counts(docs, windows, text), "terms")
    anchors = stored(anchored(windows, counts), "anchors")
    index = stored(postings(docs, anchors, size + SLACK, doc_id, text), "postings")
    rows = anchors.count()
    hits = phrase_matches(index, anchors, rows)
    near = proximity_matches(index, anchors.where(F.size(F.array_distinct("words")) == size), rows).groupBy("doc_id", "text_hash").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("near_items"))
    near = near.select(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash"), "near_items")
    spans = hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    found = spans.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), _covered(F.col("spans")).alias("n_hit"), "items")
    every = index.where("term is null").select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    both = every.join(found, every["doc_id"].eqNullSafe(found["hit_id"]) & (every["text_hash"] == found["hit_hash"]), "left")
    both = both.join(near, F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("text_hash") == F.col("near_hash")), "left")
    listed, close = (F.coalesce(c, F.array().cast("array<string>")) for c in ("items", "near_items"))
    return both.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (F.size(listed) >= min_items).alias("contaminated"),
        F.size(close).cast("long").alias("n_near"), close.alias("near_items"),
    )

"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, packing.

Each stage works on all that the one before kept; all but the last return the columns of ``documents``. Rows come in with any
nulls, repeats or extra columns that the operators define results for; extra columns are carried to the last stage but one, except
those that have the name of a column that quality rules add. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import small, stored, table
from cellweave.llm.decontaminate import decontaminate
from cellweave.llm.near_dup import near_duplicates
from cellweave.llm.packing import pack_documents
from cellweave.llm.pii import PUBLIC_KEY, key_of, pseudonymize
from cellweave.llm.quality_rules import OUTPUT, quality_rules


#: Ids up to which a list of dropped or repeated documents is broadcast (8 MB); beyond, the join shuffles.
ID_ROWS = 1_000_000
#: Words that a worker remembers in packing: the executor's heap, grown in the stages before, leaves less room than packing alone has.
REMEMBERED = 200_000


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns of documents with another text and its length."""
    kind = dict(docs.dtypes).get("n_chars", "bigint")
    new = {"text": text, "n_chars": F.length(text).cast(kind)}
    return docs.select(*(new[c].alias(c) if c in new else F.col(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, null, empty and wordless texts among them; failing lines go from the others. Repeated rows go or stay alike."""
    columns = [c for c in docs.columns if c not in OUTPUT]
    return _with_text(quality_rules(docs).where("kept"), F.col("clean_text"), columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id; of rows that repeat a doc_id, the least in the order of its columns.

    Near-duplicates have 0.8 or more of their shingles of five words in common. Rows with a null doc_id and texts without words stay.
    """
    found = stored(near_duplicates(docs, width=5).select("doc_id", "kept"), "near-dup")
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(small(gone, gone.count(), ID_ROWS), F.col("doc_id") == F.col("__gone"), "left_anti")
    twice = stored(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__again")).count().where("count > 1").select("__again"), "repeated")
    n = twice.count()
    if not n:
        return left
    again = small(twice, n, ID_ROWS)
    ordered = [c for c, kind in left.dtypes if "map<" not in kind and kind != "variant"]
    some = left.join(again, F.col("doc_id") == F.col("__again"), "left_semi")
    once = some.groupBy("doc_id").agg(F.min_by(F.struct(*left.columns), F.struct(*ordered)).alias("__row")).select("__row.*")
    return left.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(once)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any test item go: eight words in a row, a whole shorter item, or eight different words close together in any order.

    A null text has no passage; rows are told apart by doc_id and text, so a repeated or null doc_id takes no other row along.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1).where("contaminated or n_near > 0").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct()
    found = stored(found, "leaks")
    same = F.col("doc_id").eqNullSafe(F.col("__gone")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(small(found, found.count()), same, "left_anti")


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format, by the key in spark.cellweave.pii.key (a public one where that is unset). No row goes; null and empty texts stay as they are."""
    return _with_text(pseudonymize(docs, key=key_of(spark, PUBLIC_KEY)), F.col("text"), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; every row is packed, a null text as an empty one."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [("quality rules", quality), ("near-duplicates", near_dup), ("decontamination", leaks), ("pseudonyms", private), ("packing", packing)]

#: MinHash, the tokenizer and the Feistel network have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

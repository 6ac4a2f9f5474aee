import corpus_pipeline
import pytest
import test_decontaminate
import test_near_dup
import test_packing
from corpus_cases import LONG, ODD, documents
from oracle import of_duckdb, of_spark
from pyspark.sql import functions as F

from cellweave.llm import queries
from cellweave.llm.quality_rules import quality_rules


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_duckdb(queries.ORACLES[name], sf_dir)


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "pseudonyms", "packing"]


def steps(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        docs = corpus_pipeline.stored(docs, "test-" + name.replace(" ", "-"))
        out.append(docs)
    return out


def compare(spark, d):
    docs, clean, unique, safe, private, packed = steps(spark, d)
    assert all(x.columns == docs.columns for x in (clean, unique, safe, private))
    kept = quality_rules(docs).where("kept").select("doc_id", F.col("clean_text").alias("text"))
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    rows = pairs(clean)
    assert rows == pairs(kept)
    best = {}
    groups = {r[0]: r[3] for r in test_near_dup.brute(rows, width=5)}
    for i, t in rows:
        if i is None or groups[i]:
            best.setdefault(i, []).append(t)
    want = sorted(((i, t) for i, ts in best.items() for t in (ts if i is None else [min(ts)])), key=str)
    assert pairs(unique) == want
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    hits = test_decontaminate.brute(want, items)
    bad = {r[0] for r in hits if r[3]}
    assert None not in bad
    assert pairs(safe) == [x for x in want if x[0] not in bad]
    assert [i for i, _ in pairs(private)] == [i for i, _ in pairs(safe)]
    assert private.where("text <> '' and n_chars <> length(text)").count() == 0
    test_packing.check(packed.collect(), pairs(private), 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect()), key=str) and len(bad) >= 0
    return [x.count() for x in (docs, clean, unique, safe)]


def test_stages_on_the_table(spark, sf_dir):
    docs, clean, unique, safe = compare(spark, sf_dir)
    assert docs > clean > unique >= safe > 0.5 * clean


def test_stages_on_odd_documents(spark, tmp_path):
    prose = " ".join(f"plain{i} words{i} here{i}" for i in range(40))
    other = " ".join(f"other{i} words{i} there{i}" for i in range(40))
    rows = [*ODD, (20, prose), (21, prose + " tail"), (21, prose + " tail"), (22, other + " " + test_decontaminate.PASSAGE), (23, other + " mail a.b@c.example.com"), (23, other + " mail x.y@c.example.com"), (None, LONG), (None, LONG), (24, LONG)]
    documents(spark, rows, extra=("gone", "kept_not", "again", "item", "key")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, test_decontaminate.PASSAGE), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = compare(spark, str(tmp_path))
    assert counts[0] == len(rows) and counts[2] - counts[3] == 1


def test_no_documents(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

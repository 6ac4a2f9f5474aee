import re

import pytest
from cellweave.llm import url_filter as op
from corpus_cases import low

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [
    None, "", "no scheme", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net/", "http://x.net", "http://net/", "http://notexample.com/de/a", "http://example.com/de/", "http://a.b.example.com/de/1", "http://a.org/fr/?q",
    "http://a.org/fr", "http://Org/fr/x", "ftp://u@h.example.org:8080/fr/", "http://x.com?u=http://y.net/", "http://x.net#/en/", "http://spam-farm.example.org/fr/", "http://spam-farm.example.org/a", "http://www.cheap-pills.example.com/", "http://sub.free-bets.example.com/x/",
    "http://free-bets.example.com.evil.com/", "http://ÄB.example.com/\nline?x", "a://b://c/d", "http://listed.example.com/one/page/", "http://listed.example.com/one/page?x=1", "http://listed.example.com/one", "http://a.example.net/en/x", "http://a.example.net/de/x",
]
LISTED = ["spam-farm.example.org", "cheap-pills.example.com", "free-bets.example.com", "listed.example.com/one/page", None, ""]


def brute(url, listed):
    m = re.match(r"(?s)(?:(?!://).)*://([^/?#]*)([^?#]*)", url or "")
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        rule, verdict = max(fits, key=lambda x: len(x[0]))
        return host, path, rule, verdict
    bare = re.sub(r"^www\.", "", re.sub(r"\.+$", "", re.sub(r":[0-9]*$", "", re.sub(r"(?s)^.*@", "", host))))
    parts = bare.split(".")
    forms = {".".join(parts[i:]) for i in range(len(parts))} | {bare + path.rstrip("/")}
    return host, path, None, "block" if host and forms & {x for x in listed if x} else "allow"


@pytest.mark.parametrize("words", [20_000, 0])
def test_equals_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(op, "LITERAL_BLOCKS", words)
    pages = spark.createDataFrame([(i, u, "a", "b", "c", "d") for i, u in enumerate(URLS)] + [(0, None, "a", "b", "c", "d")], "page_id int, url string, host string, verdict string, entry string, block string")
    rows = op.url_filter(pages, spark.createDataFrame([(x,) for x in LISTED], "entry string")).collect()
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in rows if r["page_id"])
    assert got == [(i, *brute(u, LISTED)) for i, u in enumerate(URLS) if i]
    assert sum(r["page_id"] == 0 for r in rows) == 2 and {r["entry"] for r in rows} == {"c"}


def test_empty_list_and_empty_pages(spark):
    none = spark.createDataFrame([], "entry string")
    pages = spark.createDataFrame([(1, "http://spam-farm.example.org/")], "page_id int, url string")
    assert op.url_filter(pages, none).first()["verdict"] == "allow"
    assert op.url_filter(pages.limit(0), spark.createDataFrame([("x",)], "entry string")).count() == 0


def test_the_filter_passes_every_entry_and_few_others(spark):
    n = 3000
    entries = spark.range(n).selectExpr("concat('host', id, '.example.com') AS entry")
    blocks = n * op.BITS_PER_ENTRY // 64
    bits = {r["block"]: r["bits"] for r in op.bloom_blocks(entries, blocks).collect()}
    from pyspark.sql import functions as F

    probe = spark.range(2 * n).selectExpr("id", f"xxhash64(concat(if(id < {n}, 'host', 'other'), id, '.example.com')) AS h").select("id", op._block(F.col("h"), F.lit(blocks)).alias("b"), op._mask(F.col("h")).alias("m")).collect()
    passed = [bits.get(r["b"], 0) & r["m"] == r["m"] for r in probe]
    assert all(passed[:n]) and sum(passed[n:]) < 0.1 * n


def test_port_and_user_info_do_not_hide_a_listed_host(spark):
    n = 20_000
    entries = spark.range(n).selectExpr("concat('host', id, '.example.com') AS entry")
    urls = ["http://host7.example.com:8080/", "http://u:p@host19999.example.com/x", "http://a@b@www.host5.example.com:/", "http://x.host6.example.com:80", "http://host20000.example.com:8080/", "http://host7.example.com:80x/", "http://host7.example.com@evil.com/", "http://host9.example.com./x", "http://u@www.host9.example.com.:80"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rows = op.url_filter(pages, entries).orderBy("page_id").collect()
    assert [r["verdict"] for r in rows] == ["block"] * 4 + ["allow"] * 3 + ["block"] * 2
    assert rows[0]["host"] == "host7.example.com:8080"


def test_the_made_list_has_many_blocks_and_only_possible_hits_are_shuffled(spark):
    listed = op.made_list(spark)
    assert listed.distinct().count() == 24_000 and {r["entry"] for r in listed.where("entry like 'spam-farm%.org'").orderBy("entry").limit(2).collect()} == {"spam-farm-1.example.org", "spam-farm-10.example.org"}
    assert 24_000 * op.BITS_PER_ENTRY // 64 == 6000
    pages = spark.range(1000).selectExpr("id page_id", "concat('http://', if(id % 3 = 0, 'same.host', concat('h', id)), '.example.xyz/', id) url").union(spark.createDataFrame([(-1, "http://m.casino-win-77.example.net:1/x")], "page_id bigint, url string"))
    out = op.url_filter(pages.withColumn("url", op.F.replace("url", op.F.lit("net:1"), op.F.lit("com:1"))), listed)
    assert [r["page_id"] for r in out.where("verdict = 'block'").collect()] == [-1] and out.count() == 1001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan

"""URL filtering with built-in functions: rules by host and path, then a blocked Bloom filter before an exact hash join.

The listed canonical URLs (``host`` or ``host/path`` without scheme, user info, port, closing dot and query) are hashed into 64-bit
blocks of ``bits_per_entry * n / 64`` words: the filter grows with the list, not with the pages. Up to LITERAL_BLOCKS words it is a
constant of the plan, and every page probes with its canonical forms (host, its parent domains, host with path) where it is read:
pages without a possible hit are done, and only the others are shuffled for the exact hash join against the list, which removes
false positives. A longer filter is a table that is joined by block, by broadcast as long as its counted rows allow.

Defined results: a null url, or one without ``://``, has an empty host and path, matches no rule and is allowed. Repeated rows
are judged one by one. Null or empty entries of the list are ignored. Other columns are carried through untouched.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, small

#: (host, path, verdict); the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Words of the filter up to which it is a constant of the plan (160 KB).
LITERAL_BLOCKS = 20_000

#: The query's block list is made by a rule, as no list is given: these names, alone and with the numbers below NUMBERED, in these domains.
NAMES, DOMAINS, NUMBERED = ("spam-farm", "cheap-pills", "free-bets", "casino-win"), ("example.com", "example.org", "example.net"), 2000

BITS_PER_ENTRY, PROBES = 16, 4


def made_list(spark: SparkSession) -> DataFrame:
    """(entry): the query's block list of 24,000 hosts, made in the JVM."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    name, domain = pick(NAMES, F.col("id") % len(NAMES)), pick(DOMAINS, F.floor(F.col("id") / len(NAMES)) % len(DOMAINS))
    number = F.floor(F.col("id") / (len(NAMES) * len(DOMAINS)))
    host = F.concat(name, F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(""), F.lit("."), domain)
    return spark.range(len(NAMES) * len(DOMAINS) * NUMBERED).select(host.alias("entry"))


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def _block(h: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftright(h, 32), blocks)


def _mask(h: Column) -> Column:
    return reduce(Column.bitwiseOR, (_bit(h, i) for i in range(PROBES)))


def _bit(h: Column, i: int) -> Column:
    """One bit of a word, by six bits of the hash; 2 ** 63 wraps to the sign."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(listed: DataFrame, blocks: int, entry: str = "entry") -> DataFrame:
    """(block, bits): one 64-bit word for each block that some entry hits."""
    h = F.xxhash64(entry)
    return listed.select(_block(h, F.lit(blocks)).alias("block"), _mask(h).alias("m")).groupBy("block").agg(F.bit_or("m").alias("bits"))


def canonical_forms(host: Column, path: Column) -> Column:
    """The host, each parent domain, and the host with its path (no trailing slash), without user info, port, closing dots and a leading ``www.``."""
    bare = host
    for pattern in (r"(?s)^.*@", r":[0-9]*$", r"\.+$", r"^www\."):
        bare = F.regexp_replace(bare, pattern, "")
    parts = F.split(bare, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.array_distinct(F.concat(parents, F.array(F.concat(bare, F.regexp_replace(path, r"/+$", "")))))


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", entry: str = "entry", rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (null if none fits), ``listed`` and ``verdict`` (the rule's; else block if listed, allow if not)."""
    entries = listed.select(F.col(entry).alias("entry")).where("entry is not null and entry <> ''").distinct()
    n = entries.count()
    carried = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    judged = pages.select(*carried, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = _fits(F.col("host"), F.col("path"), r)
        rule, verdict = F.when(fits, r[0] + r[1]).otherwise(rule), F.when(fits, r[2]).otherwise(verdict)
    judged = judged.select(*carried, "host", "path", rule.alias("rule"), verdict.alias("__v"))
    if n == 0:
        return judged.select(*carried, "host", "path", "rule", F.lit(False).alias("listed"), F.coalesce("__v", F.lit("allow")).alias("verdict"))
    blocks = max(1, n * BITS_PER_ENTRY // 64)
    filters = bloom_blocks(entries, blocks)
    asked = F.col("__v").isNull() & (F.col("host") != "")
    if blocks <= LITERAL_BLOCKS:
        words = [0] * blocks
        for r in filters.collect():  # at most LITERAL_BLOCKS rows
            words[r["block"]] = r["bits"]
        constant = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

        def may_hit(h: Column) -> Column:
            return F.get(constant, _block(h, F.lit(blocks)).cast("int")).bitwiseAND(_mask(h)) == _mask(h)

        hashes = F.transform(canonical_forms(F.col("host"), F.col("path")), lambda x: F.xxhash64(x))
        asked = asked & F.exists(hashes, may_hit)
    judged = judged.withColumn("__maybe", F.coalesce(asked, F.lit(False)))
    done, open_ = judged.where(~F.col("__maybe")).withColumn("__listed", F.lit(False)), judged.where("__maybe")
    # distinct forms only: a host with a third of all pages is joined once, not once a page
    forms = open_.select("host", "path").distinct().select("host", "path", F.explode(canonical_forms(F.col("host"), F.col("path"))).alias("entry"))
    if blocks > LITERAL_BLOCKS:
        h = F.xxhash64("entry")
        forms = forms.select("host", "path", "entry", _block(h, F.lit(blocks)).alias("block"), _mask(h).alias("m")).join(small(filters, blocks), "block").where(F.col("bits").bitwiseAND(F.col("m")) == F.col("m"))
    hits = forms.join(small(entries, n), "entry").select("host", "path").distinct().withColumn("__listed", F.lit(True))
    found = open_.join(hits, ["host", "path"], "left").withColumn("__listed", F.coalesce("__listed", F.lit(False)))
    columns = [*carried, "host", "path", "rule", F.col("__listed").alias("listed"), F.coalesce("__v", F.when(F.col("__listed"), "block").otherwise("allow")).alias("verdict")]
    return done.select(*columns).unionByName(found.select(*columns))

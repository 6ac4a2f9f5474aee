"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_extract, katz, near_dup, packing, pii, quality_rules, toxicity, url_filter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word hits of benchmark windows in every document, and the items that have a window close together in any order."""
    r = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near", F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered maximal conversations."""
    return chat_format.chat_format(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fifth, to which a null doc_id does not belong."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    r = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return r.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the line-first rules for every document."""
    r = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    r = url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.made_list(spark))
    return r.select("page_id", "host", "path", "rule", "verdict")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data pseudonymised."""
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii.key_of(spark, pii.PUBLIC_KEY))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and backoff scores of every document, learned from six sevenths of them."""
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz.katz_scores(table(spark, sf_dir, "documents"), held)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_chat_format, op3_toxicity, op4_quality_rules, op5_url_filter, op6_pii, op7_packing, op8_near_dup, op9_katz, op10_html_extract)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PUNCT_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_PUNCT_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PUNCT_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, list_slice(w, s, s + 7) AS win FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k, win[1] AS first FROM wins),
tok AS (SELECT doc_id, w, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
spans AS (SELECT tok.doc_id, tok.p, sizes.k, list_slice(tok.w, tok.p, tok.p + sizes.k - 1) AS win FROM tok JOIN sizes ON tok.t = sizes.first),
hit AS (SELECT spans.doc_id, spans.p, spans.k, wins.item FROM spans JOIN wins ON spans.win = wins.win),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id),
freq AS (SELECT t, count(*) AS n FROM tok GROUP BY t),
sets AS (SELECT DISTINCT win FROM wins WHERE len(win) = 8 AND len(list_distinct(win)) = 8),
rare AS (SELECT win, arg_min(q.t, (n, k)) AS anchor FROM (SELECT win, unnest(win) AS t, unnest(range(0, 8)) AS k FROM sets) AS q JOIN freq ON q.t = freq.t GROUP BY win HAVING count(*) = 8),
close AS (SELECT DISTINCT tok.doc_id, rare.win FROM tok JOIN rare ON tok.t = rare.anchor WHERE list_has_all(list_slice(tok.w, greatest(1, tok.p - 9), tok.p + 9), rare.win)),
near AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM close JOIN wins ON close.win = wins.win GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, CAST(coalesce(len(its.items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(its.items, ','), '')) AS items_sha256, coalesce(len(its.items), 0) >= 2 AS contaminated,
       CAST(coalesce(len(near.items), 0) AS BIGINT) AS n_near, sha256(coalesce(array_to_string(near.items, ','), '')) AS near_sha256
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN near ON d.doc_id = near.doc_id""",
    "op2_chat_format": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS pre FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)),
f AS (SELECT min(conv_id) AS conv_id FROM c WHERE turns NOT IN (SELECT pre FROM p) GROUP BY turns)
SELECT c.conv_id, CAST(c.n AS BIGINT) AS n_turns,
       list_aggregate(list_transform(c.turns, lambda u: '<|' || replace(replace(coalesce(u.r, ''), '<|', '<\|'), '|>', '|\>') || '|>' || chr(10) || replace(replace(coalesce(u.x, ''), '<|', '<\|'), '|>', '|\>')), 'string_agg', chr(10)) AS rendered
FROM c JOIN f ON c.conv_id = f.conv_id""",
    "op4_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM w WHERE len(w) >= 3),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS x FROM w),
f AS (SELECT doc_id, x, length(x) AS n, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS c, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS k,
             regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words FROM lines),
b AS (SELECT doc_id, n, (10 * len(regexp_extract_all(x, '[#*$%&|<>]')) > c)
        OR (k >= 3 AND 2 * len(regexp_extract_all(x, '!!')) > k)
        OR (len(regexp_extract_all(x, ' \| ')) >= 3) OR (k >= 4 AND 2 * len(regexp_extract_all(x, '[»›•|]')) > k)
        OR (k BETWEEN 1 AND 3 AND NOT regexp_matches(words[k], '[.!?…:;。！？]['')"”’»\]]*$'))
        OR (k >= 10 AND CASE WHEN 4 * len(list_distinct(words)) < k THEN 4 * len(list_filter(range(2, k + 1), lambda i: list_contains(list_slice(words, greatest(1, i - 8), i - 1), words[i]))) > 3 * k ELSE false END)
        OR regexp_matches(x, '(?i)(licensed under the|all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|copyright \(c\)|subscribe to our newsletter)') AS bad FROM f),
s AS (SELECT doc_id, sum(n) AS whole, sum(CASE WHEN bad THEN 0 ELSE n END) AS rest, count(*) FILTER (WHERE bad) AS n_lines_removed FROM b GROUP BY doc_id),
o AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, whole, rest, n_lines_removed
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id JOIN s ON w.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * rest >= 50 * whole AS kept, n_lines_removed FROM o""",
    "op5_url_filter": r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM (SELECT DISTINCT page_id, host, path FROM u) AS u
      JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '(^|\.)(spam-farm|cheap-pills|free-bets|casino-win)(-([1-9][0-9]{0,2}|1[0-9]{3}))?\.example\.(com|org|net)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id""",
}

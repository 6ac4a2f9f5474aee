"""The registered queries over the driver's tables, each with its SQL.

The log of cells is the ``events`` table: partition key ``user_id``, clustering key ``day``, column ``event_type``, sequence
``event_id + 1``, and a tombstone for every seventh event. Queries only combine the library's operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..functions import codec, hashing, hlc
from ..operators import compaction, mutations, replay, resolve, versions
from ..schema import ADDRESS
from ..sources import dump, wal
from ..sources.shared import literal_rows, shared_dir
from ..sources.store import Store
from ..streaming import latest as streaming

KEYS = ("user_id", "day", "event_type")
TYPES = ("click", "view", "purchase", "signup", "error")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_log(_table(spark, sf_dir, "events"))


def _as_log(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.to_date("ts").cast("string").alias("day"), "event_type", "value", "props", (F.col("event_id") + 1).alias("sequence"), (F.col("event_id") % 7 == 0).alias("is_tombstone"), "event_id")


def _cells(log: DataFrame) -> DataFrame:
    return log.select(*KEYS, "value", "sequence", "is_tombstone")


def _key(log: DataFrame | None = None):
    return codec.encode_key(*(codec.to_bytes(F.col(c)) for c in KEYS))


def q_latest_live(spark, d):
    return resolve.live(_cells(events_log(spark, d)), KEYS)


def q_latest_raw(spark, d):
    return resolve.latest(_cells(events_log(spark, d)), KEYS)


def q_latest_window(spark, d):
    return resolve.latest(_cells(events_log(spark, d)), KEYS)


def q_latest_aggregate(spark, d):
    return resolve.latest_by_aggregate(_cells(events_log(spark, d)), KEYS)


def q_point_get(spark, d):
    log = _cells(events_log(spark, d))
    first = log.where("sequence = 6").select(*KEYS).first()
    return resolve.get(log, *first, keys=KEYS)


def q_get_raw(spark, d):
    log = _cells(events_log(spark, d))
    first = log.where("sequence = 8").select(*KEYS).first()
    return resolve.get_raw(log, *first, keys=KEYS)


def q_multi_get(spark, d):
    log = _cells(events_log(spark, d))
    return resolve.multi_get(log, log.where("sequence % 11 = 0").select(*KEYS).distinct(), KEYS)


def q_partition_scan(spark, d):
    return resolve.partition_scan(_cells(events_log(spark, d)), 7, KEYS)


def q_range_scan(spark, d):
    return resolve.range_scan(_cells(events_log(spark, d)), F.col("user_id"), 20, 60, keys=KEYS)


def q_range_scan_bounds(spark, d):
    log, out = _cells(events_log(spark, d)), None
    for low in (True, False):
        for high in (True, False):
            part = resolve.range_scan(log, F.col("user_id"), 10, 14, low, high, KEYS).withColumn("bounds", F.lit(f"{'[' if low else '('}{']' if high else ')'}"))
            out = part if out is None else out.unionByName(part)
    return out


def q_encode_key(spark, d):
    return events_log(spark, d).select("event_id", F.hex(_key()).alias("key_hex"))


def q_decode_key(spark, d):
    raw = events_log(spark, d).select("event_id", codec.decode_key(_key()).alias("k"))
    return raw.select("event_id", *(codec.to_text(F.col(f"k.{c}")).alias(c) for c in ("partition_key", "clustering_key", "column_name")))


def q_key_order(spark, d):
    keys = events_log(spark, d).select(*KEYS).distinct()
    return mutations.with_sequence(keys, _key(), 1).select(*KEYS, F.col("sequence").alias("place"))


MALFORMED = ("616200", "610002000100010001", "61620001", "", "00", "00010001", "000100010001", "61000100FF0001620001", "6100016200016300019999", "610001620001630001", "6100FF0001620001630001")


def q_decode_malformed(spark, d):
    cases = spark.createDataFrame([(x,) for x in MALFORMED], "key_hex string")
    return cases.select("key_hex", codec.key_is_valid(F.unhex("key_hex")).alias("valid"))


def q_int_codec(spark, d):
    o = _table(spark, d, "orders")
    big = F.col("o_orderkey") * 1_000_003
    return o.select("o_orderkey", F.hex(codec.encode_uint(F.col("o_orderkey") % 65536, 2)).alias("u16"), F.hex(codec.encode_uint(F.col("o_orderkey"), 4)).alias("u32"), F.hex(codec.encode_uint(big, 8)).alias("u64"), codec.decode_uint(codec.encode_uint(big, 8)).cast("bigint").alias("back"))


def _runs(log: DataFrame) -> list[DataFrame]:
    return [_cells(log.where(F.col("event_id") % 3 == k)) for k in range(3)]


def q_merge_two_runs(spark, d):
    a, b, _ = _runs(events_log(spark, d))
    return resolve.merge_runs(a, b, keys=KEYS)


def _merged(spark, d, inputs: list[int]) -> DataFrame:
    """The merge of some of three runs, which loses its tombstones if the rule allows it."""
    runs = _runs(events_log(spark, d))
    return compaction.compact([runs[k] for k in inputs], compaction.can_drop_tombstones(range(len(runs)), inputs), KEYS)


def q_tombstones_kept(spark, d):
    """A merge of the newer two of three runs: the oldest may hold what its tombstones hide, so they stay."""
    return _merged(spark, d, [1, 2])


def q_tombstones_dropped(spark, d):
    """A merge of the older two of three runs: nothing older is left for its tombstones to hide."""
    return _merged(spark, d, [0, 1])


def q_full_compaction(spark, d):
    return _merged(spark, d, [0, 1, 2])


def q_compaction_stats(spark, d):
    log = events_log(spark, d).withColumn("run", F.col("event_id") % 3)
    return compaction.run_stats(log, "run", F.concat(*(F.col(c).cast("string") for c in KEYS)), F.col("props"))


def q_entry_sum(spark, d):
    """Entries of the inputs of each merge of the first n runs, for which its filter is sized."""
    sizes = {r["run"]: r["entry_count"] for r in q_compaction_stats(spark, d).collect()}
    metas = [compaction.RunMeta(k, 0, sizes[k]) for k in sorted(sizes)]
    return literal_rows(spark, [{"runs": n, "entries": compaction.entry_sum(metas[:n])} for n in range(1, len(metas) + 1)], "runs bigint, entries bigint")


def q_live_bytes(spark, d):
    log = events_log(spark, d).select(*KEYS, "props", "sequence", "is_tombstone")
    return resolve.live_bytes(log, ["user_id"], F.concat(*(F.col(c).cast("string") for c in KEYS)), F.col("props"), KEYS)


def q_superseded(spark, d):
    return resolve.superseded(events_log(spark, d), ["event_type"], KEYS)


def q_history(spark, d):
    return _history(events_log(spark, d).select(*KEYS, "sequence"))


def _history(log: DataFrame) -> DataFrame:
    return resolve.history(log, KEYS).select(*KEYS, "sequence", F.col("version").cast("bigint").alias("version"), "replaced_by")


def q_reclaimable(spark, d):
    o = _table(spark, d, "orders")
    pending = o.select((F.col("o_custkey") % 60).alias("file_id")).distinct()
    held = o.where("o_orderkey % 20 >= 18").groupBy((F.col("o_orderkey") % 20).alias("version")).agg(F.collect_set(F.col("o_custkey") % 41).alias("files"))
    return versions.reclaimable(pending, held)


def _edits(orders: DataFrame) -> DataFrame:
    gone = F.collect_set(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 37))
    come = F.collect_set(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") % 40))
    return orders.groupBy((F.col("o_orderkey") % 20).alias("version")).agg(gone.alias("removed"), come.alias("added"))


def q_version_apply(spark, d):
    return versions.files_at(_edits(_table(spark, d, "orders")))


def q_version_stale(spark, d):
    o = _table(spark, d, "orders")
    return versions.stale(o.select((F.col("o_custkey") % 50).alias("file_id")).distinct(), versions.files_at(_edits(o), 9))


def q_snapshot_at(spark, d):
    """The live cells at each quarter of the log."""
    log = _cells(events_log(spark, d))
    last = log.agg(F.max("sequence")).first()[0] or 0
    marks = F.filter(F.array(*(F.lit(last * k // 4) for k in (1, 2, 3, 4))), lambda n: n >= F.col("sequence"))
    return resolve.live(log.withColumn("at_sequence", F.explode(marks)), ("at_sequence", *KEYS))


def _customer_runs(customers: DataFrame) -> DataFrame:
    size = (F.floor(F.abs(F.col("c_acctbal")) * 10) + 1).cast("bigint")
    return customers.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_custkey").alias("file_id"), size.alias("size_bytes"))).alias("runs"))


def q_size_tier_pick(spark, d):
    runs = _customer_runs(_table(spark, d, "customer"))
    return runs.select("c_nationkey", F.array_join(compaction.size_tier_pick(F.col("runs"), 3, 5), ",").alias("inputs"))


def _droppable(runs: DataFrame) -> DataFrame:
    r = runs.withColumn("live", F.col("runs.file_id"))
    picks = {"oldest": F.slice(F.sort_array("live"), 1, 2), "newest": F.slice(F.sort_array("live", False), 1, 2), "all": F.col("live"), "none": F.array().cast("array<bigint>")}
    one = r.select("c_nationkey", *(compaction.can_drop_column(F.col("live"), p).alias(k) for k, p in picks.items()))
    return one.select("c_nationkey", *picks)


def q_can_drop(spark, d):
    return _droppable(_customer_runs(_table(spark, d, "customer")))


def _wal(log: DataFrame) -> DataFrame:
    return log.withColumn("segment", F.floor(F.col("event_id") / 100).cast("bigint")).withColumn("offset", F.col("event_id") % 100).withColumn("valid", F.col("event_id") % 61 != 60)


def q_wal_replay(spark, d):
    """Every segment of the log: the active one is the one after the last."""
    wal = _wal(events_log(spark, d))
    last = wal.agg(F.max("segment")).first()[0]
    return _cells_of(replay.replayed(wal, 0 if last is None else last + 1))


def _cells_of(records: DataFrame) -> DataFrame:
    return resolve.latest(_cells(records), KEYS)


def q_torn_tail(spark, d):
    return _cells_of(replay.valid_prefix(_wal(events_log(spark, d))))


def q_torn_tail_join(spark, d):
    return _cells_of(replay.valid_prefix_by_join(_wal(events_log(spark, d))))


def q_seq_assign(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return mutations.with_sequence(o, F.struct("o_custkey", "o_orderkey"), 100)


def q_next_lsn(spark, d):
    log = events_log(spark, d)
    high = log.agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("sequence"))).alias("r"), F.max(F.when(F.col("event_id") % 2 == 1, F.col("sequence"))).alias("w"))
    return high.select((F.greatest(F.coalesce("r", F.lit(0)) + 1, F.coalesce("w", F.lit(0))) + F.when(F.col("w").isNull(), 0).otherwise(1)).alias("next_lsn"))


def q_file_names(spark, d):
    s = _table(spark, d, "supplier")
    run, log = codec.run_file_name(F.col("s_suppkey") * 101), codec.log_file_name(F.col("s_suppkey"))
    return s.select("s_suppkey", run.alias("run_file"), log.alias("log_file"), codec.parse_run_file_name(F.concat(F.lit("/data/sst/"), run)).alias("run_id"), codec.parse_run_file_name(log).alias("not_a_run"), codec.parse_log_file_name(log).alias("segment"))


def q_row_pivot(spark, d):
    return resolve.pivot_rows(q_latest_live(spark, d), list(TYPES), ["user_id", "day"], "event_type", "value")


def q_row_width(spark, d):
    maps = resolve.row_maps(q_latest_live(spark, d), ["user_id", "day"], "event_type", "value")
    return maps.select("user_id", "day", F.array_join(F.map_keys("cells"), ",").alias("columns"))


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def q_cells_unpivot(spark, d):
    wide = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("sequence"), (F.col("l_returnflag") == "R").alias("is_tombstone"), *LINE)
    cells = resolve.unpivot(wide, ["l_orderkey", "l_linenumber", "sequence", "is_tombstone"], list(LINE))
    return resolve.live(cells, ("l_orderkey", "l_linenumber", "column_name"))


def q_trim_config(spark, d):
    c = _table(spark, d, "customer")
    padded = F.concat(F.lit(" \t\n"), F.col("c_name"), F.lit("\r\u000b\u000c "))
    return c.select("c_custkey", codec.trim_blanks(padded).alias("trimmed"), codec.mib_to_bytes(F.col("c_custkey")).alias("as_bytes"), codec.bytes_to_mib(F.col("c_custkey") * 3_000_000).alias("as_mib"))


def q_text_bytes(spark, d):
    p = _table(spark, d, "part")
    return p.select("p_partkey", F.hex(codec.to_bytes(F.col("p_name"))).alias("raw"), codec.to_text(codec.to_bytes(F.col("p_name"))).alias("back"))


def q_hlc(spark, d):
    e = _table(spark, d, "events")
    millis = hlc.epoch_millis(F.col("ts"), isinstance(e.schema["ts"].dataType, TimestampType))
    candidate = hlc.pack(millis - millis % 3_600_000)  # the hour, towards 1970
    e = e.select("event_id", "user_id", candidate.alias("candidate"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = [F.col("event_id").asc_nulls_last(), F.col("file"), F.col("row")]  # of rows with one event_id, the table's
    clock = hlc.timestamps(F.col("candidate"), order, partition=F.col("user_id"))
    return e.select("event_id", clock.alias("hlc_ts"))


def q_crc32c(spark, d):
    p = _table(spark, d, "part")
    return p.select("p_partkey", hashing.crc32c_column(codec.to_bytes(F.col("p_name"))).alias("crc"))


def q_hash32(spark, d):
    p = _table(spark, d, "part")
    return p.select("p_partkey", *(hashing.hash32_column(codec.to_bytes(F.col("p_name")), F.lit(seed)).alias(f"h{k}") for k, seed in enumerate(hashing.SEEDS)))


def q_bloom_fpr(spark, d):
    c = _table(spark, d, "customer").select("c_custkey", codec.to_bytes(F.col("c_name")).alias("key"))
    inside = c.where("c_custkey % 2 = 0")
    n = inside.count()
    probed = hashing.bloom_probe(c, "key", hashing.bloom_words(inside, "key", n), n)
    return probed.groupBy((F.col("c_custkey") % 2 == 0).alias("stored")).agg(F.count("*").alias("probes"), F.sum(F.col("may_contain").cast("bigint")).alias("positive"))


def q_stream_latest(spark, d):
    kind = _table(spark, d, "events").schema
    stream = _as_log(streaming.read_log(spark, d, kind, "events.parquet"))
    return streaming.run_to_table(streaming.stream_latest(stream, ["user_id", "event_type"], ["value", "is_tombstone"]))


def _mutations(log: DataFrame) -> DataFrame:
    value = F.when(~F.col("is_tombstone"), codec.to_bytes(F.col("props"))).alias("value")
    return log.select("event_id", *(codec.to_bytes(F.col(c)).alias(n) for c, n in zip(KEYS, ADDRESS, strict=True)), value, "is_tombstone")


def _texts(cells: DataFrame, *rest) -> DataFrame:
    return cells.select(*(codec.to_text(F.col(n)).alias(c) for c, n in zip(KEYS, ADDRESS, strict=True)), codec.to_text(F.col("value")).alias("value"), *rest)


def q_store_roundtrip(spark, d):
    """Batches through a store with flushes and compactions on the way, then a crash, a new start, and a vacuum of all that is old."""
    root, rows = shared_dir(spark, "store"), _mutations(events_log(spark, d))
    store = Store.open(spark, root, flush_bytes=1 << 40, policy=compaction.SizeTiered(2, 4))
    for k in range(4):
        store.write(rows.where(F.col("event_id") % 4 == k), F.col("event_id"))
        if k != 3:
            store.flush()
    store = Store.open(spark, root, flush_bytes=1 << 40)
    store.vacuum(retain_ms=0)
    return _texts(store.live())


def _three_runs(spark, d) -> Store:
    root, rows = shared_dir(spark, "store"), _mutations(events_log(spark, d))
    store = Store.open(spark, root, flush_bytes=1 << 40, policy=compaction.SizeTiered(100, 100))
    for k in range(3):
        store.write(rows.where(F.col("event_id") % 3 == k), F.col("event_id"))
        store.flush()
    return store


def q_run_footers(spark, d):
    """What a pinned version says of its runs."""
    pin = _three_runs(spark, d).snapshot()
    rows = [{"file_id": f.file_id, "entry_count": f.entry_count, "highest_sequence": f.max_sequence} for f in pin.files()]
    pin.release()
    return literal_rows(spark, rows, "file_id bigint, entry_count bigint, highest_sequence bigint")


def q_run_dump(spark, d):
    """Every cell of the second of three runs."""
    return dump.dump(_three_runs(spark, d), 2)[1]


def q_wal_binary(spark, d):
    """The log written as binary segments, read again and resolved."""
    path = shared_dir(spark, "wal")
    log = _mutations(events_log(spark, d)).select(*ADDRESS, "value", "is_tombstone", (F.col("event_id") + 1).alias("sequence"), F.lit(0).cast("bigint").alias("hlc_ts"))
    wal.write_segments(log, path, rows=20_000)
    return _texts(resolve.latest(wal.to_log(replay.valid_prefix_by_join(wal.read_segments(spark, path)))), "sequence", "is_tombstone")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}

_EV = "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, value, props, event_id + 1 AS sequence, event_id % 7 = 0 AS is_tombstone, event_id FROM events"


def _newest(source: str, keys: str = "user_id, day, event_type", where: str = "", out: str = "user_id, day, event_type, value, sequence, is_tombstone") -> str:
    return f"SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY sequence DESC, is_tombstone DESC) AS rn FROM ({source}) AS s) AS r WHERE rn = 1 {where}"


def _live(source: str, keys: str = "user_id, day, event_type", out: str = "user_id, day, event_type, value, sequence") -> str:
    return _newest(source, keys, "AND NOT is_tombstone", out)


def _pairs(x: str) -> str:
    return rf"replace(replace(regexp_replace(hex(encode({x})), '(..)', '\1 ', 'g'), '00 ', '00 FF '), ' ', '') || '0001'"


_KEYHEX = " || ".join(_pairs(f"CAST({c} AS VARCHAR)") for c in KEYS)
_EDITS = """SELECT o_orderkey % 20 AS version, o_custkey % 37 AS file_id, 0 AS added FROM orders WHERE o_orderkey % 3 = 0
UNION SELECT o_orderkey % 20, o_custkey % 40, 1 FROM orders WHERE o_orderkey % 5 = 0"""
_FILES = "SELECT file_id FROM (SELECT file_id, added, row_number() OVER (PARTITION BY file_id ORDER BY version DESC, added DESC) AS rn FROM ({0}) AS e {1}) AS x WHERE rn = 1 AND added = 1"
_WALSQL = f"SELECT *, event_id // 100 AS segment, event_id % 100 AS place, event_id % 61 <> 60 AS valid FROM ({_EV}) AS e"
_TORN = f"SELECT * FROM (SELECT *, bool_and(valid) OVER (PARTITION BY segment ORDER BY place ROWS UNBOUNDED PRECEDING) AS ok FROM ({_WALSQL}) AS w) AS t WHERE ok"
_CUST = "SELECT c_nationkey, c_custkey AS id, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) + 1 AS size FROM customer"

_NAMES = "SELECT {0} AS id, [ascii(x) FOR x IN string_split({1}, '')] AS b FROM {2}"
_CRC = f"""WITH t AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda a, i: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 2197175160 ELSE 0 END)) AS v FROM range(256) AS r(n)))
SELECT id AS p_partkey, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t.t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) AS crc FROM ({_NAMES.format("p_partkey", "p_name", "part")}) AS n, t"""


def _hash(seed: int) -> str:
    """The seeded hash of a list of bytes b: big-endian words, then a little-endian rest, in 128 bits and cut to 32 after each product."""
    cut = lambda x, k: f"xor(({x}) * 3332679571 % 4294967296, (({x}) * 3332679571 % 4294967296) >> {k})"
    words = "list_transform(range(0, len(b) // 4), lambda k: CAST(((b[4 * k + 1] * 256 + b[4 * k + 2]) * 256 + b[4 * k + 3]) * 256 + b[4 * k + 4] AS HUGEINT))"
    whole = f"list_reduce(list_prepend(CAST(xor(CAST({seed} AS HUGEINT), len(b) * CAST(3332679571 AS HUGEINT) % 4294967296) AS HUGEINT), {words}), lambda h, w: {cut('h + w', 16)})"
    rest = "list_sum(list_transform(range(0, len(b) % 4), lambda k: b[len(b) // 4 * 4 + k + 1] * (1 << (8 * k))))"
    last = f"CAST({whole} + coalesce({rest}, 0) AS HUGEINT)"
    return f"CAST(CASE WHEN len(b) % 4 = 0 THEN {whole} ELSE {cut(last, 24)} END AS BIGINT)"


_BLOOM = f"""WITH c AS (SELECT id, {_hash(0xBC9F1D34)} AS x, {_hash(0x6C8E9CF5)} AS y FROM ({_NAMES.format("c_custkey", "c_name", "customer")}) AS n),
s AS (SELECT k, CAST(ceil(CAST(floor(-k * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) / 8) AS BIGINT) * 8 AS m FROM (SELECT count(*) AS k FROM c WHERE id % 2 = 0)),
p AS (SELECT id, (x + i * (CASE WHEN y % 2 = 1 THEN y ELSE y + 1 END)) % m AS bit FROM c, s, range(30) AS r(i) WHERE i < greatest(1, least(30, CAST(floor(m / k * ln(2)) AS BIGINT)))),
b AS (SELECT DISTINCT bit FROM p WHERE id % 2 = 0),
f AS (SELECT p.id, bool_and(b.bit IS NOT NULL) AS hit FROM p LEFT JOIN b ON p.bit = b.bit GROUP BY p.id)
SELECT id % 2 = 0 AS stored, count(*) AS probes, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM f GROUP BY 1"""
_STORED = "SELECT *, event_id % 3 + 1 AS run, (row_number() OVER (ORDER BY event_id % 3, event_id)) AS place FROM ({0}) AS e"

ORACLES = {
    "q_crc32c": _CRC,
    "q_hash32": f"SELECT id AS p_partkey, {_hash(0xBC9F1D34)} AS h0, {_hash(0x6C8E9CF5)} AS h1 FROM ({_NAMES.format('p_partkey', 'p_name', 'part')}) AS n",
    "q_bloom_fpr": _BLOOM,
    "q_run_footers": f"SELECT run AS file_id, count(DISTINCT (user_id, day, event_type)) AS entry_count, max(place) AS highest_sequence FROM ({_STORED.format(_EV)}) AS s GROUP BY run",
    "q_run_dump": f"SELECT user_id || '_' || day || '_' || event_type AS key, CASE WHEN is_tombstone THEN '' ELSE props END AS val, is_tombstone AS tom, place AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY place DESC) AS rn FROM ({_STORED.format(_EV)}) AS s WHERE run = 2) AS r WHERE rn = 1",
    "q_wal_binary": f"SELECT CAST(user_id AS VARCHAR) AS user_id, day, event_type, CASE WHEN is_tombstone THEN NULL ELSE props END AS value, sequence, is_tombstone FROM ({_newest(_EV, out='*')}) AS n",
    "q_latest_live": _live(_EV),
    "q_latest_raw": _newest(_EV),
    "q_latest_window": _newest(_EV),
    "q_latest_aggregate": _newest(_EV),
    "q_point_get": f"WITH ev AS ({_EV}) {_live('SELECT ev.* FROM ev JOIN (SELECT user_id AS u, day AS d, event_type AS t FROM ev WHERE sequence = 6) AS k ON user_id = u AND day = d AND event_type = t')}",
    "q_get_raw": f"WITH ev AS ({_EV}) {_newest('SELECT ev.* FROM ev JOIN (SELECT user_id AS u, day AS d, event_type AS t FROM ev WHERE sequence = 8) AS k ON user_id = u AND day = d AND event_type = t')}",
    "q_multi_get": f"WITH ev AS ({_EV}), k AS (SELECT DISTINCT user_id, day, event_type FROM ev WHERE sequence % 11 = 0), l AS ({_live('SELECT * FROM ev')}) SELECT k.user_id, k.day, k.event_type, l.value, l.sequence FROM k LEFT JOIN l ON k.user_id = l.user_id AND k.day = l.day AND k.event_type = l.event_type",
    "q_partition_scan": _live(f"SELECT * FROM ({_EV}) AS e WHERE user_id = 7"),
    "q_range_scan": _live(f"SELECT * FROM ({_EV}) AS e WHERE user_id >= 20 AND user_id < 60"),
    "q_range_scan_bounds": f"WITH l AS ({_live(_EV)}) SELECT *, '[]' AS bounds FROM l WHERE user_id BETWEEN 10 AND 14 UNION ALL SELECT *, '[)' FROM l WHERE user_id >= 10 AND user_id < 14 UNION ALL SELECT *, '(]' FROM l WHERE user_id > 10 AND user_id <= 14 UNION ALL SELECT *, '()' FROM l WHERE user_id > 10 AND user_id < 14",
    "q_encode_key": f"SELECT event_id, {_KEYHEX} AS key_hex FROM ({_EV}) AS e",
    "q_decode_key": f"SELECT event_id, CAST(user_id AS VARCHAR) AS partition_key, day AS clustering_key, event_type AS column_name FROM ({_EV}) AS e",
    "q_key_order": f"SELECT user_id, day, event_type, row_number() OVER (ORDER BY encode(CAST(user_id AS VARCHAR)), encode(day), encode(event_type)) AS place FROM (SELECT DISTINCT user_id, day, event_type FROM ({_EV}) AS e) AS k",
    "q_decode_malformed": "SELECT key_hex, regexp_full_match(regexp_replace(key_hex, '(..)', '\\1 ', 'g'), '(((0[1-9A-F]|[1-9A-F].) |00 FF )*00 01 ){3}(.. )*') AS valid FROM (VALUES " + ", ".join(f"('{k}')" for k in MALFORMED) + ") AS t(key_hex)",
    "q_int_codec": "SELECT o_orderkey, printf('%04X', o_orderkey % 65536) AS u16, printf('%08X', o_orderkey) AS u32, printf('%016X', o_orderkey * 1000003) AS u64, o_orderkey * 1000003 AS back FROM orders",
    "q_merge_two_runs": _newest(f"SELECT * FROM ({_EV}) AS e WHERE event_id % 3 < 2"),
    "q_tombstones_kept": _newest(f"SELECT * FROM ({_EV}) AS e WHERE event_id % 3 > 0"),
    "q_tombstones_dropped": _newest(f"SELECT * FROM ({_EV}) AS e WHERE event_id % 3 < 2", where="AND NOT is_tombstone"),
    "q_full_compaction": _newest(_EV, where="AND NOT is_tombstone"),
    "q_compaction_stats": f"SELECT event_id % 3 AS run, count(*) AS entry_count, min(sequence) AS min_sequence, max(sequence) AS max_sequence, CAST(sum(strlen(CAST(user_id AS VARCHAR)) + strlen(day) + strlen(event_type) + coalesce(strlen(props), 0) + 17) AS BIGINT) AS logical_bytes FROM ({_EV}) AS e GROUP BY 1",
    "q_entry_sum": "SELECT n AS runs, CAST((SELECT count(*) FROM events WHERE event_id % 3 < n) AS BIGINT) AS entries FROM range(1, 4) AS t(n)",
    "q_live_bytes": f"SELECT user_id, CAST(sum(strlen(CAST(user_id AS VARCHAR)) + strlen(day) + strlen(event_type) + CASE WHEN is_tombstone THEN 0 ELSE coalesce(strlen(props), 0) END) AS BIGINT) AS live_bytes FROM ({_newest(_EV, out='*')}) AS n GROUP BY user_id",
    "q_superseded": f"SELECT event_type, CAST(sum(v) AS BIGINT) AS versions, count(*) AS addresses, CAST(sum(v - 1) AS BIGINT) AS hidden FROM (SELECT user_id, day, event_type, count(*) AS v FROM ({_EV}) AS e GROUP BY ALL) AS g GROUP BY event_type",
    "q_history": f"SELECT user_id, day, event_type, sequence, row_number() OVER w AS version, lead(sequence) OVER w AS replaced_by FROM ({_EV}) AS e WINDOW w AS (PARTITION BY user_id, day, event_type ORDER BY sequence)",
    "q_reclaimable": "SELECT DISTINCT o_custkey % 60 AS file_id FROM orders WHERE o_custkey % 60 NOT IN (SELECT o_custkey % 41 FROM orders WHERE o_orderkey % 20 >= 18)",
    "q_version_apply": _FILES.format(_EDITS, ""),
    "q_version_stale": f"SELECT DISTINCT o_custkey % 50 AS file_id FROM orders WHERE o_custkey % 50 NOT IN ({_FILES.format(_EDITS, 'WHERE version <= 9')})",
    "q_snapshot_at": _live(f"SELECT * FROM ({_EV}) AS e JOIN (SELECT (max(event_id) + 1) * k // 4 AS at_sequence FROM events, range(1, 5) AS q(k) GROUP BY k) AS m ON sequence <= at_sequence", "at_sequence, user_id, day, event_type", "at_sequence, user_id, day, event_type, value, sequence"),
    "q_size_tier_pick": f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY size, id) AS k FROM ({_CUST}) AS c),
s(c_nationkey, k, id, bucket, n, total) AS (
  SELECT c_nationkey, k, id, 1, 1, CAST(size AS DOUBLE) FROM r WHERE k = 1
  UNION ALL SELECT r.c_nationkey, r.k, r.id, CASE WHEN r.size >= 0.5 * (s.total / s.n) AND r.size <= 1.5 * (s.total / s.n) THEN s.bucket ELSE s.bucket + 1 END,
    CASE WHEN r.size >= 0.5 * (s.total / s.n) AND r.size <= 1.5 * (s.total / s.n) THEN s.n + 1 ELSE 1 END,
    CASE WHEN r.size >= 0.5 * (s.total / s.n) AND r.size <= 1.5 * (s.total / s.n) THEN s.total + r.size ELSE CAST(r.size AS DOUBLE) END
  FROM s JOIN r ON r.c_nationkey = s.c_nationkey AND r.k = s.k + 1),
b AS (SELECT c_nationkey, bucket, list_sort(list(id)) AS ids FROM s GROUP BY c_nationkey, bucket HAVING count(*) >= 3),
p AS (SELECT c_nationkey, arg_min(ids, ids[1]) AS ids FROM b GROUP BY c_nationkey)
SELECT n.c_nationkey, array_to_string(list_slice(p.ids, 1, 5), ',') AS inputs FROM (SELECT DISTINCT c_nationkey FROM r) AS n LEFT JOIN p ON n.c_nationkey = p.c_nationkey""",
    "q_can_drop": f"""SELECT c_nationkey, true AS oldest, len(ids) <= 2 AS newest, true AS "all", false AS "none" FROM (SELECT c_nationkey, list_sort(list(id)) AS ids FROM ({_CUST}) AS c GROUP BY c_nationkey) AS g""",
    "q_wal_replay": _newest(_WALSQL),
    "q_torn_tail": _newest(_TORN),
    "q_torn_tail_join": _newest(_TORN),
    "q_seq_assign": "SELECT o_orderkey, o_custkey, 99 + row_number() OVER (ORDER BY o_custkey, o_orderkey) AS sequence FROM orders",
    "q_next_lsn": "SELECT max(event_id) + 2 + CASE WHEN max(event_id) % 2 = 0 THEN 1 ELSE 0 END AS next_lsn FROM events",
    "q_file_names": "SELECT s_suppkey, printf('sst_%08d.db', s_suppkey * 101) AS run_file, printf('wal_%08d.log', s_suppkey) AS log_file, s_suppkey * 101 AS run_id, CAST(0 AS BIGINT) AS not_a_run, s_suppkey AS segment FROM supplier",
    "q_row_pivot": f"SELECT user_id, day, {', '.join(f'''max(CASE WHEN event_type = '{t}' THEN value END) AS "{t}"''' for t in TYPES)} FROM ({_live(_EV)}) AS l GROUP BY user_id, day",
    "q_row_width": f"SELECT user_id, day, string_agg(event_type, ',' ORDER BY event_type) AS columns FROM ({_live(_EV)}) AS l GROUP BY user_id, day",
    "q_cells_unpivot": "SELECT l_orderkey, l_linenumber, column_name, value, sequence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, column_name ORDER BY sequence DESC, is_tombstone DESC, value DESC) AS rn FROM (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, l_suppkey AS sequence, l_returnflag = 'R' AS is_tombstone, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM lineitem" for c in LINE) + ") AS u) AS r WHERE rn = 1 AND NOT is_tombstone",
    "q_trim_config": "SELECT c_custkey, c_name AS trimmed, c_custkey * 1048576 AS as_bytes, (c_custkey * 3000000) // 1048576 AS as_mib FROM customer",
    "q_text_bytes": "SELECT p_partkey, hex(encode(p_name)) AS raw, p_name AS back FROM part",
    "q_hlc": "SELECT event_id, i + max(c - i) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS hlc_ts FROM (SELECT event_id, user_id, (epoch_ms(ts) // 3600000 * 3600000) * 65536 AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) AS e",
    "q_stream_latest": f"SELECT user_id, event_type, sequence, value, is_tombstone FROM ({_newest(_EV, 'user_id, event_type', out='*')}) AS n",
    "q_store_roundtrip": f"SELECT CAST(user_id AS VARCHAR) AS user_id, day, event_type, props AS value FROM ({_live('SELECT user_id, day, event_type, value, props, (event_id % 4) * 1000000000 + event_id AS sequence, is_tombstone FROM (' + _EV + ') AS e', out='*')}) AS n",
}

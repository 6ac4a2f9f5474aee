"""The store end to end: flushes, recovery, deletes, compaction, snapshots, concurrent writers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cellweave import errors
from cellweave.operators.compaction import FullCompaction, SizeTiered
from cellweave.sources.files import Files
from cellweave.sources.store import Store, create_engine

NEVER = SizeTiered(1000, 1000)
ROWS = "partition_key binary, clustering_key binary, column_name binary, value binary, is_tombstone boolean, o int"


def key(k):
    return k, b"2026-01", b"age"


def batch(spark, items):
    """items: (name, value or None for a delete)."""
    rows = [(bytearray(k), bytearray(b"2026-01"), bytearray(b"age"), None if v is None else bytearray(v), v is None, i) for i, (k, v) in enumerate(items)]
    return spark.createDataFrame(rows, ROWS)


def write(store, *items):
    return store.write(batch(store.spark, items), F.col("o"))


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_put_get_delete_over_flushes(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    s.put(*key(b"alice"), b"12")
    assert s.get(*key(b"alice")) == b"12" and s.get(*key(b"bob")) is None
    assert s.flush() and not s.flush()
    assert s.get(*key(b"alice")) == b"12"
    s.remove(*key(b"alice"))
    assert s.get(*key(b"alice")) is None and s.get_internal(*key(b"alice"))["is_tombstone"]
    s.flush()
    assert s.get(*key(b"alice")) is None and len(s.runs) == 2


def test_an_empty_value_is_refused_and_nothing_is_written(spark, root):
    s = Store.open(spark, root)
    with pytest.raises(errors.BadConfig):
        write(s, (b"a", b"1"), (b"b", b""))
    assert s.latest_lsn() == 1 and s.live().count() == 0
    with pytest.raises(errors.BadConfig):
        Store.open(spark, "  ")
    with pytest.raises(errors.BadConfig):
        create_engine("unknown", spark, root)
    with pytest.raises(errors.BadConfig):
        s.set_compaction_policy(None)


def test_crash_recovery_keeps_values_and_sequences(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    write(s, (b"alice", b"32"), (b"john", b"30"), (b"sourav", b"26"))
    s.flush()
    write(s, (b"gourav", b"24"), (b"tuffy", b"5"))
    write(s, (b"tuffy", None))
    again = Store.open(spark, root, policy=NEVER)
    assert [again.get_internal(*key(k))["sequence"] for k in (b"alice", b"john", b"sourav", b"gourav", b"tuffy")] == [1, 2, 3, 4, 6]
    assert again.get(*key(b"tuffy")) is None and again.get(*key(b"gourav")) == b"24"
    assert again.latest_lsn() == 7
    write(again, (b"new", b"1"))
    assert again.get_internal(*key(b"new"))["sequence"] == 7


def test_flush_by_size(spark, root):
    s = Store.open(spark, root, flush_bytes=60, policy=NEVER)
    write(s, (b"k", b"artyom"))
    assert not s.runs
    write(s, *((b"key%d" % i, b"artyom") for i in range(5)))
    assert len(s.runs) == 1 and s.runs[0].entry_count == 6


def test_compactions_drop_what_was_deleted(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    for i in range(3):
        write(s, *((b"%d__%d" % (i, k), b"v%d" % k) for k in range(40)))
        s.flush()
        write(s, *((b"%d__%d" % (i, k), None) for k in range(1, 40, 2)))
        s.flush()
    assert len(s.runs) == 6 and s.log().count() == 180
    old = s.snapshot()
    assert s.compact_now() is not None
    assert len(s.runs) == 1 and s.runs[0].entry_count == 60 and s.log().where("is_tombstone").count() == 0
    assert not [x for x in s.vacuum(retain_ms=0) if x.startswith("runs/")] and old.live().count() == 60  # the pinned version keeps its runs
    old.release()
    assert len([x for x in s.vacuum(retain_ms=0) if x.startswith("runs/")]) == 6 and s.live().count() == 60


def test_partial_compaction_keeps_tombstones_that_hide_older_runs(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    write(s, *((b"k%d" % i, b"v" * 900) for i in range(50)))
    s.flush()
    for i in range(3):
        write(s, (b"k%d" % i, None))
        s.flush()
    s.compact(SizeTiered(3, 3))
    assert len(s.runs) == 2 and s.log().where("is_tombstone").count() == 3
    assert s.get(*key(b"k1")) is None and s.live().count() == 47


def test_time_travel_and_a_slower_writer(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    write(s, (b"a", b"1"))
    s.flush()
    other = Store.open(spark, root, policy=NEVER)
    write(s, (b"a", b"2"))
    s.flush()
    assert bytes(s.snapshot(1).get(*key(b"a")).first()["value"]) == b"1"
    assert bytes(s.snapshot().get(*key(b"a")).first()["value"]) == b"2"
    with pytest.raises(errors.StaleVersion):
        other._publish([], [])
    assert other.compact(FullCompaction()) is None and other.version == s.version  # it has caught up instead
    assert other.get(*key(b"a")) == b"2"


def test_scan_is_in_key_order(spark, root):
    s = Store.open(spark, root)
    rows = [(bytearray(b"p"), bytearray(b"%03d" % i), bytearray(b"c"), bytearray(b"x"), False, i) for i in (5, 1, 9, 3)]
    s.write(spark.createDataFrame(rows, ROWS), F.col("o"))
    assert [bytes(r["clustering_key"]) for r in s.scan(b"p").collect()] == [b"001", b"003", b"005", b"009"]


def test_random_operations_against_a_dictionary(spark, root):
    rng, model = random.Random(7), {}
    s = Store.open(spark, root, policy=SizeTiered(2, 3))
    for _ in range(7):
        items = []
        for _ in range(25):
            k = b"k%d" % rng.randrange(20)
            v = None if rng.random() < 0.3 else b"v%d" % rng.randrange(1000)
            items.append((k, v))
            model.pop(k, None) if v is None else model.__setitem__(k, v)
        write(s, *items)
        act = rng.choice(["flush", "reopen", "compact", "none"])
        if act == "flush":
            s.flush()
        elif act == "reopen":
            s = Store.open(spark, root, policy=SizeTiered(2, 3))
        elif act == "compact":
            s.flush()
            s.compact_now()
        assert {bytes(r["partition_key"]): bytes(r["value"]) for r in s.live().collect()} == model


def test_error_codes_are_distinct():
    kinds = errors.StoreError.kinds()
    assert len(kinds) == 15 and kinds[1001] is errors.StaleVersion


def test_vacuum_asks_the_manifest_not_the_object(spark, root):
    a, b = Store.open(spark, root, policy=NEVER), Store.open(spark, root, policy=NEVER)
    write(a, (b"a", b"1"))
    a.flush()
    assert b.version == 0
    assert [x for x in b.vacuum(retain_ms=0) if x.startswith("runs/")] == []
    assert a.live().count() == 1 and b.live().count() == 1
    pin = b.snapshot()
    write(a, (b"a", b"2"))
    a.flush()
    a.compact_now()
    a.vacuum(retain_ms=0, grace_ms=0)  # another object than the one that pinned
    assert bytes(pin.get(*key(b"a")).first()["value"]) == b"1"
    pin.release()
    a.vacuum(retain_ms=0)
    with pytest.raises(errors.StaleVersion):
        b.snapshot(pin.version)
    assert b.get(*key(b"a")) == b"2"


def test_vacuum_keeps_young_versions_and_unpublished_work(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    for k in (b"1", b"2"):
        write(s, (b"a", k))
        s.flush()
    run = s._write_run(s.log())  # written, not published yet
    s.compact_now()
    assert s.vacuum() == [] and s.snapshot(2).live().count() == 1
    assert run.path not in s.vacuum(retain_ms=0) and s.files.exists(run.path)
    assert run.path in s.vacuum(retain_ms=0, grace_ms=0) and s.live().count() == 1


def test_of_two_publishers_one_is_stale(spark, root):
    from concurrent.futures import ThreadPoolExecutor

    stores = [Store.open(spark, root, policy=NEVER) for _ in range(8)]

    def publish(s):
        try:
            s._publish([], [])
            return 1
        except errors.StaleVersion:
            return 0

    for k in range(1, 4):
        with ThreadPoolExecutor(8) as pool:
            assert sum(pool.map(publish, stores)) == 1
        assert {s.refresh().number for s in stores} == {k}


def test_two_writers_share_no_number_and_lose_nothing(spark, root):
    from concurrent.futures import ThreadPoolExecutor

    stores = [Store.open(spark, root, policy=NEVER) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: [write(stores[k], *((b"%d-%d-%d" % (k, j, i), b"v") for i in range(3))) for j in range(3)], range(2)))
    rows = stores[0].unflushed().orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(1, 19)) and len({r["hlc_ts"] for r in rows}) == 18
    assert [r["hlc_ts"] for r in rows] == sorted(r["hlc_ts"] for r in rows)
    assert stores[0].flush() and not stores[1].flush() and stores[1].live().count() == 18


def test_the_clock_never_steps_back(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    now = [1_000_000]
    s.clock.now = lambda: now[0]
    write(s, (b"a", b"1"), (b"b", b"1"))
    now[0] = 10
    write(s, (b"c", b"1"))
    clocks = {bytes(r["partition_key"]): r["hlc_ts"] for r in s.unflushed().collect()}
    assert clocks == {b"a": 1_000_000 << 16, b"b": (1_000_000 << 16) + 1, b"c": (1_000_000 << 16) + 2}


def test_a_segment_that_no_version_names_is_not_there(spark, root, monkeypatch):
    s = Store.open(spark, root, policy=NEVER)
    write(s, (b"a", b"1"))

    def crash(*_, **__):
        raise RuntimeError("crash")

    monkeypatch.setattr(s, "_append", crash)
    with pytest.raises(RuntimeError):
        write(s, (b"a", b"2"))
    again = Store.open(spark, root, policy=NEVER)
    assert again.get(*key(b"a")) == b"1" and len([x for x in again.vacuum(grace_ms=0) if x.startswith("log/")]) == 1


def test_equal_orders_go_by_the_address(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    rows = [(bytearray(b"k%03d" % (k % 50)), bytearray(b"c"), bytearray(b"x"), bytearray(b"v"), False, 0) for k in random.Random(1).sample(range(50), 50)]
    s.write(spark.createDataFrame(rows, ROWS).repartition(5), F.col("o"))
    assert [bytes(r["partition_key"]) for r in s.unflushed().orderBy("sequence").collect()] == [b"k%03d" % k for k in range(50)]


def test_runs_are_ranges_of_the_key_order_with_bloom_filters(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    rows = spark.range(40_000).selectExpr("cast(concat('p', hash(id)) as binary) partition_key", "cast(cast(id as string) as binary) clustering_key", "cast('c' as binary) column_name", "cast(repeat('v', 60) as binary) value", "false is_tombstone", "id o")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s.write(rows, F.col("o"))
        s.flush()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    scan = s.run_scan(1).collect()
    assert scan == sorted(scan, key=lambda r: (r["partition_key"], r["clustering_key"]))
    files = s._runs(s.runs).groupBy("_metadata.file_path").agg(F.min("partition_key").alias("low"), F.max("partition_key").alias("high")).orderBy("low").collect()
    assert len(files) > 1 and all(a["high"] <= b["low"] for a, b in zip(files, files[1:], strict=False))
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(files[0]["file_path"]), s.files.conf))
    columns = {c.getPath().toDotString(): c for c in reader.getFooter().getBlocks().get(0).getColumns()}
    reader.close()
    assert columns["clustering_key"].getBloomFilterOffset() > 0
    assert s.get(bytes(scan[5]["partition_key"]), bytes(scan[5]["clustering_key"]), b"c") == b"v" * 60
    assert s.scan(bytes(scan[7]["partition_key"])).count() >= 1


def test_reads_of_a_key_leave_out_runs_that_cannot_hold_it(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    for name in (b"a", b"m", b"z"):
        write(s, (name, b"1"), (name + b"\x00", b"2"))
        s.flush()
    assert s.get_internal(*key(b"m"))["sequence"] == 3 and s.scan(b"z").count() == 1 and s.scan(b"z\x00").count() == 1 and s.scan(b"q").count() == 0
    assert len(s._near((b"m",)).inputFiles()) == 1 and not s._near((b"q",)).inputFiles()


def test_damaged_stores_do_not_open(spark, root):
    s = Store.open(spark, root, policy=NEVER)
    write(s, (b"a", b"1"))
    s.flush()
    run = s.runs[0]
    assert s.check(1) == run
    part = next(n for n in s.files.names(run.path) if n.endswith(".parquet"))
    raw = s.files.read(f"{run.path}/{part}")
    for bad, deep, kind in ((raw + b"x", False, errors.BadConfig), (raw[:-4] + b"NOPE", True, errors.BadMagic)):
        s.files.delete(f"{run.path}/{part}")
        s.files.append(f"{run.path}/{part}", bad)
        with pytest.raises(kind):
            s.check(1, deep)
    s.files.rename(run.path, "runs/elsewhere")
    with pytest.raises(errors.BadFile):
        Store.open(spark, root)
    with pytest.raises(errors.BadConfig):
        s.check(99)
    newest = s.files.names("versions")[-1]
    text = s.files.read(f"versions/{newest}").decode()
    for bad, kind in (("{}", errors.BadMagic), ("not json", errors.BadMagic), (text.replace("next_lsn", "next_lsm"), errors.BadConfig), (text.replace("cellweave-version-2", "other"), errors.BadMagic)):
        s.files.delete(f"versions/{newest}")
        s.files.append(f"versions/{newest}", bad.encode())
        with pytest.raises(kind):
            Store.open(spark, root)


def test_file_operations(spark, tmp_path):
    f = Files(spark, f"file://{tmp_path}/files")
    f.make("_drafts")
    assert f.append("a", b"12345") == 0 and f.append("a", b"678") == 5
    assert f.read("a") == b"12345678" and f.read_at("a", 4, 3) == b"567" and f.size("a") == 8
    for bad in ((6, 3), (-1, 2), (9, 1)):
        with pytest.raises(errors.OutOfRange):
            f.read_at("a", *bad)
    with pytest.raises(errors.BadDescriptor):
        f.read("none")
    with pytest.raises(errors.StatFailed):
        f.size("none")
    assert f.create("b", "x") and not f.create("b", "y") and f.read("b") == b"x" and f.names("_drafts") == []
    f.delete("b")
    assert f.names("") == ["_drafts", "a"]
    with pytest.raises(errors.WriteFailed):
        f.rename("none", "c")


def test_a_dump_shows_the_footer_and_every_cell(spark, root, capsys):
    from cellweave.sources import dump

    s = Store.open(spark, root, policy=NEVER)
    write(s, (b"b", b"1"), (b"a", b"2"), (b"b", None))
    s.flush()
    footer, cells = dump.dump(s, 1)
    assert footer["entry_count"] == 2 and footer["highest_sequence"] == 3 and footer["size_bytes"] == s.runs[0].size_bytes
    assert [(r["key"], r["val"], r["tom"], r["seq"]) for r in cells.collect()] == [("a_2026-01_age", "2", False, 2), ("b_2026-01_age", "", True, 3)]
    assert dump.main([root, "1"], spark) == 0 and "entry_count: 2" in (out := capsys.readouterr().out) and "[ENCODED] key: a_2026-01_age   val: 2  tom: false  seq: 2" in out
    assert dump.main([root], spark) == 1 and dump.main([root, "7"], spark) == 1


def test_log_lines(spark, root):
    import logging

    from cellweave import log

    ring = log.RingHandler(3)
    log.configure(logging.INFO, {"io": logging.ERROR}, ring)
    try:
        s = Store.open(spark, root, policy=NEVER)
        write(s, (b"a", b"1"))
        s.flush()
        assert re.fullmatch(r"\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}\] \[INFO \] \[memtable\] \[TID:\d+\] store\.py:\d+ flush: flushed 1 segments to run 1: 1 entries", ring.lines[-1])
        log.logger("io").info("not shown")
        log.logger("elsewhere").critical("shown")
        assert "[FATAL] [unknown]" in ring.lines[-1] and len(ring.lines) == 3
    finally:
        logging.getLogger("cellweave").removeHandler(ring)
    assert log.level_name(log.TRACE) == "TRACE" and log.level_name(33) == "UNKNOW"

"""Newest version per key, merges of runs, lookups and scans."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import mutations, replay, resolve, versions

KEY = ("k",)
RUN = "k string, value string, sequence bigint, is_tombstone boolean"

#: case: runs of name:sequence (T marks a tombstone), then the sequences of the merged names in their order.
MERGES = {
    "interleave": (["ada:1 delphi:4", "basic:2 elixir:5", "cobol:3 fortran:6"], "1 2 3 4 5 6"),
    "uneven": (["ada:1", "basic:2 delphi:4 elixir:5", "cobol:3", "fortran:6", ""], "1 2 3 4 5 6"),
    "dedup": (["ada:1 elixir:5", "basic:2 delphi:4 elixir:6", "cobol:3", "elixir:7 fortran:8", "elixir:9"], "1 2 3 4 9 8"),
    "tombstone": (["ada:1", "basic:2 delphi:4 elixir:5", "cobol:3", "fortran:6", "delphi:7T"], "1 2 3 7T 5 6"),
    "insert beats tombstone": (["ada:1", "basic:2 delphi:4 elixir:5", "cobol:3 delphi:7T", "fortran:6", "delphi:8"], "1 2 3 8 5 6"),
}


def run_of(spark, text):
    rows = []
    for item in text.split():
        name, s = item.split(":")
        rows.append((name, None if s.endswith("T") else name, int(s.rstrip("T")), s.endswith("T")))
    return spark.createDataFrame(rows, RUN)


@pytest.mark.parametrize("case", MERGES)
@pytest.mark.parametrize("backwards", [False, True])
def test_merge(spark, case, backwards):
    runs, want = MERGES[case]
    frames = [run_of(spark, r) for r in (reversed(runs) if backwards else runs)]
    rows = resolve.merge_runs(*frames, keys=KEY).orderBy("k").collect()
    assert [f"{r['sequence']}{'T' * r['is_tombstone']}" for r in rows] == want.split()
    assert all(r["value"] == (None if r["is_tombstone"] else r["k"]) for r in rows)


def log_of(spark, rows):
    return spark.createDataFrame(rows, RUN)


def test_both_forms_of_latest_equal_a_dictionary_on_random_logs(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(40)}", f"v{i}", i, rng.random() < 0.3) for i in range(600)]
    want = {k: (v, s, t) for k, v, s, t in rows}
    log = log_of(spark, rng.sample(rows, len(rows)))
    for form in (resolve.latest, resolve.latest_by_aggregate):
        assert {r["k"]: (r["value"], r["sequence"], r["is_tombstone"]) for r in form(log, KEY).collect()} == want
    live = {k: v for k, (v, _, t) in want.items() if not t}
    assert {r["k"]: r["value"] for r in resolve.live(log, KEY).collect()} == live


def test_ties_of_the_sequence_resolve_by_tombstone_then_value(spark):
    log = log_of(spark, [("a", "x", 1, False), ("a", "y", 1, False), ("b", "z", 2, False), ("b", None, 2, True)])
    for form in (resolve.latest, resolve.latest_by_aggregate):
        assert sorted(map(tuple, form(log, KEY).select("k", "value", "is_tombstone").collect())) == [("a", "y", False), ("b", None, True)]


def test_empty_log(spark):
    log = log_of(spark, [])
    assert resolve.latest(log, KEY).count() == resolve.live(log, KEY).count() == resolve.get(log, "a", keys=KEY).count() == 0


def test_lookups_and_ranges(spark):
    log = log_of(spark, [("a", "1", 1, False), ("b", "2", 2, False), ("b", None, 3, True), ("c", "3", 4, False), ("d", "4", 5, False)])
    assert resolve.get(log, "a", keys=KEY).first()["value"] == "1"
    assert resolve.get(log, "b", keys=KEY).first() is None
    assert resolve.get_raw(log, "b", keys=KEY).first()["is_tombstone"]
    assert resolve.get(log, "z", keys=KEY).first() is None
    wanted = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    assert {r["k"]: r["value"] for r in resolve.multi_get(log, wanted, KEY).collect()} == {"a": "1", "b": None, "z": None}
    span = lambda *x, **y: sorted(r["k"] for r in resolve.range_scan(log, F.col("k"), *x, **y, keys=KEY).collect())
    assert span("a", "d") == ["a", "c"]
    assert span("a", "d", end_inclusive=True) == ["a", "c", "d"]
    assert span("a", "d", start_inclusive=False) == ["c"]
    assert span() == ["a", "c", "d"]
    assert span("x", "b") == []
    assert sorted(r["k"] for r in resolve.snapshot_at(log, 2, KEY).collect()) == ["a", "b"]


def test_rows_from_cells_and_back(spark):
    cells = spark.createDataFrame([("r1", "age", "3"), ("r1", "name", "x"), ("r2", "age", "4")], "row string, column_name string, value string")
    wide = {r["row"]: (r["age"], r["name"]) for r in resolve.pivot_rows(cells, ["age", "name"], ["row"]).collect()}
    assert wide == {"r1": ("3", "x"), "r2": ("4", None)}
    assert {r["row"]: r["cells"] for r in resolve.row_maps(cells, ["row"]).collect()} == {"r1": {"age": "3", "name": "x"}, "r2": {"age": "4"}}
    back = resolve.unpivot(resolve.pivot_rows(cells, ["age", "name"], ["row"]), ["row"], ["age", "name"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_sequences_are_gap_free_in_order_over_many_partitions(spark):
    rows = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("x"))
    got = mutations.with_sequence(rows, F.col("x"), 51, 8).orderBy("x").collect()
    assert [(r["x"], r["sequence"]) for r in got] == [(i, 51 + i) for i in range(1000)]


def test_next_sequence_has_a_gap_of_one_after_a_replay():
    assert [mutations.next_sequence(4, None), mutations.next_sequence(3, 5), mutations.next_sequence(5, 3), mutations.next_sequence(0, None)] == [5, 6, 7, 1]


def test_replay_stops_at_the_first_bad_record_of_each_segment(spark):
    rows = [(s, o, not (s == 1 and o == 3)) for s in (1, 2) for o in range(6)]
    wal = spark.createDataFrame(rows, "segment bigint, offset bigint, valid boolean")
    want = [(1, 0), (1, 1), (1, 2), *((2, o) for o in range(6))]
    for form in (replay.valid_prefix, replay.valid_prefix_by_join):
        assert sorted((r["segment"], r["offset"]) for r in form(wal).collect()) == want
    assert replay.replayed(wal, 2).count() == 6


def test_version_edits(spark):
    edits = spark.createDataFrame([(1, [], [1, 2]), (2, [1, 2], [3]), (3, [], [1]), (4, [3], [3])], "version int, removed array<int>, added array<int>")
    at = lambda v=None: sorted(r["file_id"] for r in versions.files_at(edits, v).collect())
    assert [at(0), at(1), at(2), at(3), at()] == [[], [1, 2], [3], [1, 3], [1, 3]]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "file_id int")
    assert [r["file_id"] for r in versions.stale(ids(1, 9), versions.files_at(edits)).collect()] == [9]
    assert sorted(r["file_id"] for r in versions.apply_edit(ids(1, 3), ids(3), ids(1, 7)).collect()) == [1, 7]
    held = spark.createDataFrame([(1, [1, 2]), (2, [3])], "version int, files array<int>")
    assert [r["file_id"] for r in versions.reclaimable(ids(2, 3, 4), held).collect()] == [4]

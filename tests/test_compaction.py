"""The choice of runs, the fate of tombstones, and the merge."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import compaction
from cellweave.operators.compaction import RunMeta, SizeTiered

M = 1_000_000
#: case: (min, max), sizes of the live runs 1.., chosen inputs, whether tombstones can go.
POLICY = {
    "two tiers": ((3, 3), [M, 10 * M] * 4, [1, 3, 5], False),
    "uniform": ((3, 3), [M] * 8, [1, 2, 3], True),
    "one huge": ((3, 4), [M, M, M, 90_000 * M], [1, 2, 3], True),
    "exactly min": ((3, 3), [M] * 3, [1, 2, 3], True),
    "too few": ((3, 3), [M] * 2, None, None),
    "exactly max": ((3, 5), [M] * 8, [1, 2, 3, 4, 5], True),
    "a gap": ((3, 8), [M, M, M, 9000 * M, M, M, M, M], [1, 2, 3, 5, 6, 7, 8], False),
    "no gap": ((3, 8), [M] * 8, [1, 2, 3, 4, 5, 6, 7, 8], True),
    "none": ((3, 5), [], None, None),
}
#: live runs, inputs, whether tombstones of the inputs can go.
DROPS = [
    ([1, 2, 3, 4], [1, 2, 3, 4], True), ([1], [1], True), ([1, 2, 3, 4], [1, 2], True), ([1, 2, 3, 4], [2, 4], False),
    ([1, 2], [2], False), ([1, 2, 3, 4], [3, 4], False), ([1, 2, 3, 4], [], False), ([1, 2], [1, 2, 3, 4], False),
]


@pytest.mark.parametrize("case", POLICY)
def test_size_tiered_choice(case):
    (low, high), sizes, inputs, drop = POLICY[case]
    picked = SizeTiered(low, high).pick([RunMeta(i, s) for i, s in enumerate(sizes, 1)])
    assert (picked and (list(picked.inputs), picked.can_drop_tombstones)) == (inputs and (inputs, drop))


def test_size_tiered_choice_as_an_expression(spark):
    for case, ((low, high), sizes, inputs, _) in POLICY.items():
        rows = [(case, [(i, s) for i, s in enumerate(sizes, 1)])]
        df = spark.createDataFrame(rows, "c string, runs array<struct<file_id:bigint,size_bytes:bigint>>")
        assert df.select(compaction.size_tier_pick(F.col("runs"), low, high)).first()[0] == inputs, case


def test_full_compaction_takes_all():
    assert compaction.FullCompaction().pick([]) is None
    assert compaction.FullCompaction().pick([RunMeta(4, 1), RunMeta(2, 9)]) == compaction.Candidate((2, 4), True)


def test_widths_are_checked():
    with pytest.raises(ValueError):
        SizeTiered(4, 3)


@pytest.mark.parametrize(("live", "inputs", "want"), DROPS)
def test_tombstones_can_go_only_with_the_oldest_runs(spark, live, inputs, want):
    assert compaction.can_drop_tombstones(live, inputs) == want
    df = spark.createDataFrame([(live, inputs)], "live array<int>, inputs array<int>")
    assert df.select(compaction.can_drop_column(F.col("live"), F.col("inputs"))).first()[0] == want


def test_the_rule_by_sequence_sees_old_data_in_a_new_run():
    old, mid, fresh = RunMeta(9, 1, 1, 1, 10, b"a", b"f"), RunMeta(2, 1, 1, 11, 20, b"a", b"f"), RunMeta(3, 1, 1, 21, 30, b"a", b"f")
    assert compaction.can_drop_by_sequence([old, mid, fresh], [9, 2])
    assert not compaction.can_drop_by_sequence([old, mid, fresh], [2, 3])  # run 9 is older though its id is larger
    assert compaction.can_drop_by_sequence([RunMeta(9, 1, 1, 1, 10, b"x", b"z"), mid], [2])  # its keys lie elsewhere
    assert not compaction.can_drop_by_sequence([old], []) and not compaction.can_drop_by_sequence([old], [7])


def test_compaction_keeps_or_drops_tombstones(spark):
    schema = "k int, value string, sequence bigint, is_tombstone boolean"
    a = spark.createDataFrame([(1, "a", 1, False), (2, "b", 2, False)], schema)
    b = spark.createDataFrame([(1, None, 3, True), (3, "c", 4, False)], schema)
    keep = compaction.compact([a, b], False, ("k",)).collect()
    assert sorted((r["k"], r["is_tombstone"]) for r in keep) == [(1, True), (2, False), (3, False)]
    assert sorted(r["k"] for r in compaction.compact([a, b], True, ("k",)).collect()) == [2, 3]
    stats = compaction.run_stats(a.withColumn("run", F.lit(5)), "run", F.col("k").cast("string"), F.col("value")).first()
    assert tuple(stats) == (5, 2, 1, 2, 2 * (1 + 1 + 17))

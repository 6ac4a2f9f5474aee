"""Every registered query of the store against its SQL."""

import pytest

from cellweave.plans import queries
from oracle import of_duckdb, of_spark


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert of_spark(queries.QUERIES[name](spark, sf_dir)) == of_duckdb(queries.ORACLES[name], sf_dir)


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_key_filter_reaches_the_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    plan = queries.resolve.get(queries._cells(queries.events_log(spark, sf_dir)), 5, "2024-01-02", "click", keys=queries.KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,5)" in plan and "EqualTo(event_type,click)" in plan and "props" not in plan.split("ReadSchema")[1]
    live = queries.q_latest_live(spark, sf_dir).where(F.col("value") > 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value" not in live  # a filter on values stays above the resolution


def test_whole_replay_reaches_the_last_segment(spark, sf_dir):
    last = queries.events_log(spark, sf_dir).agg({"sequence": "max"}).first()[0]
    assert queries.q_wal_replay(spark, sf_dir).agg({"sequence": "max"}).first()[0] == last


def test_whole_queries_have_every_key_edit_and_run(spark, sf_dir):
    from cellweave.operators.compaction import RunMeta, SizeTiered

    assert queries.q_history(spark, sf_dir).count() == queries.events_log(spark, sf_dir).count()
    edited = queries._edits(spark.read.parquet(f"{sf_dir}/orders.parquet")).collect()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").collect()
    assert {(r["version"], f) for r in edited for f in r["added"]} == {(o["o_orderkey"] % 20, o["o_custkey"] % 40) for o in orders if o["o_orderkey"] % 5 == 0}
    runs = {r["c_nationkey"]: r["runs"] for r in queries._customer_runs(spark.read.parquet(f"{sf_dir}/customer.parquet")).collect()}
    assert sum(map(len, runs.values())) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    for r in queries.q_size_tier_pick(spark, sf_dir).collect():
        picked = SizeTiered(3, 5).pick([RunMeta(x["file_id"], x["size_bytes"]) for x in runs[r["c_nationkey"]]])
        assert r["inputs"] == (",".join(map(str, picked.inputs)) if picked else None)


def _events(path, rows):
    """rows: event_id, ts, user_id."""
    from datetime import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    ids, times, users = zip(*rows, strict=True)
    times = [t and datetime.fromisoformat(t) for t in times]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "ts": pa.array(times, pa.timestamp("us")), "user_id": pa.array(users, pa.int64())}), path)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize(
    "rows",
    [
        [(1, "2024-01-01 00:59:59.999499", 1), (2, "2024-01-01 00:10:00", 1), (3, "2024-03-10 02:30:00", 1)],
        [(1, "2024-01-01 00:59:59.999500", 1), (2, "2024-01-01 00:10:00", 1), (3, "2024-01-01 01:59:59.999999", 2)],
        [(1, None, 1), (2, "2024-01-01 00:10:00", 1), (3, None, 1), (1, None, 2)],
        [(None, "2024-01-01 00:10:00", 1), (2, "2024-01-01 03:10:00", 1), (4, "2024-01-01 03:10:00", None)],
        [(1, "1969-12-31 21:59:59.999499", 1), (2, "1969-12-31 21:59:59.999500", 1), (3, "1969-12-31 23:30:00", 1), (1, "1969-12-31 20:59:59.999501", 2)],
    ],
    ids=["before half a ms", "within half a ms of the hour", "no time", "no event_id", "before 1970"],
)
def test_hlc_equals_its_sql_on_odd_rows(spark, tmp_path, rows, zone):
    _events(tmp_path / "events.parquet", rows)
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = of_spark(queries.q_hlc(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert got == of_duckdb(queries.ORACLES["q_hlc"], tmp_path)


def test_hlc_takes_rows_of_one_event_id_in_the_order_of_the_table(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    _events(tmp_path / "events.parquet" / "part-0.parquet", [(5, "2024-01-01 03:00:00", 1)])
    _events(tmp_path / "events.parquet" / "part-1.parquet", [(5, f"2024-01-01 {h:02}:00:00", 1) for h in (1, 7, 2)] + [(6, "2024-01-01 00:00:00", u) for u in range(2, 500)])  # larger, so read first
    got = sorted(r["hlc_ts"] for r in queries.q_hlc(spark, str(tmp_path)).where("event_id = 5").collect())
    hour, base = 3_600_000 << 16, 1_704_067_200_000 << 16
    assert got == [base + 3 * hour, base + 3 * hour + 1, base + 7 * hour, base + 7 * hour + 1]

"""From the log of cells to what is visible: newest versions, live cells, lookups, scans, rows.

The order of versions is by sequence, then tombstone, then value, so equal sequences resolve the same way on any cluster. Filters
on the address go below the resolution (Catalyst moves them to the scan); filters on values and tombstones must stay above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ADDRESS

#: Keys of a multi-get up to which they are broadcast; beyond, the join shuffles.
BROADCAST_KEYS = 100_000


def latest(log: DataFrame, keys=ADDRESS, order: str = "sequence") -> DataFrame:
    """The newest version of every key, tombstones included, as one hash shuffle on the keys.

    Spark limits each key to its newest row before the shuffle, so a key with a third of all rows is one row a task. Of three forms
    this took the least time with narrow and wide payloads, with and without a hot key (README).
    """
    rest = [c for c in log.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in dict.fromkeys((order, "is_tombstone", "value")) if c in log.columns))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, *rest)


def latest_by_aggregate(log: DataFrame, keys=ADDRESS, order: str = "sequence") -> DataFrame:
    """The same as a partial aggregate of structs, which sorts as well but can be carried on from stored partial results."""
    rest = [c for c in log.columns if c not in keys]
    first = [order] + [c for c in ("is_tombstone", "value") if c in rest and c != order]
    best = F.max(F.struct(*first, *(c for c in rest if c not in first))).alias("__v")
    return log.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__v.{c}").alias(c) for c in rest))


def live(log: DataFrame, keys=ADDRESS) -> DataFrame:
    """The visible cells: newest versions that are no tombstones. The filter comes after the resolution, never before."""
    return latest(log, keys).where(~F.col("is_tombstone")).drop("is_tombstone")


def get(log: DataFrame, *key, keys=ADDRESS) -> DataFrame:
    """The live cell of one address: one row or none, for keys never written and for deleted ones alike."""
    return live(_at(log, key, keys), keys)


def get_raw(log: DataFrame, *key, keys=ADDRESS) -> DataFrame:
    """The newest version of one address, which may be a tombstone."""
    return latest(_at(log, key, keys), keys)


def _at(log: DataFrame, key: tuple, keys) -> DataFrame:
    return log.where(reduce(lambda a, b: a & b, (F.col(c) == F.lit(k) for c, k in zip(keys, key, strict=True))))


def multi_get(log: DataFrame, wanted: DataFrame, keys=ADDRESS) -> DataFrame:
    """Every wanted key with its live value, null where there is none. The log is cut to the wanted keys before it is resolved."""
    asked = wanted.select(*keys).distinct()
    few = asked if asked.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS else F.broadcast(asked)
    found = live(log.join(few, list(keys), "left_semi"), keys)
    return wanted.join(found, list(keys), "left")


def partition_scan(log: DataFrame, partition, keys=ADDRESS) -> DataFrame:
    """All live cells of one partition in key order."""
    return live(log.where(F.col(keys[0]) == F.lit(partition)), keys).orderBy(*keys)


def in_range(key: Column, start=None, end=None, start_inclusive: bool = True, end_inclusive: bool = False) -> Column:
    """Predicate of a key range, half-open unless told otherwise; a missing bound is open."""
    out = F.lit(True)
    if start is not None:
        out = out & (key >= start if start_inclusive else key > start)
    if end is not None:
        out = out & (key <= end if end_inclusive else key < end)
    return out


def range_scan(log: DataFrame, key: Column, start=None, end=None, start_inclusive: bool = True, end_inclusive: bool = False, keys=ADDRESS) -> DataFrame:
    """The live cells whose key lies in a range; the range is a predicate on key columns and reaches the scan."""
    return live(log.where(in_range(key, start, end, start_inclusive, end_inclusive)), keys)


def snapshot_at(log: DataFrame, sequence: int, keys=ADDRESS) -> DataFrame:
    """Live cells as of a sequence number."""
    return live(log.where(F.col("sequence") <= sequence), keys)


def superseded(log: DataFrame, by: list[str], keys=ADDRESS) -> DataFrame:
    """Versions, distinct keys and hidden versions for each value of ``by`` (columns of the key)."""
    each = log.groupBy(*keys).agg(F.count("*").alias("v"))
    return each.groupBy(*by).agg(F.sum("v").alias("versions"), F.count("*").alias("addresses"), F.sum(F.col("v") - 1).alias("hidden"))


def history(log: DataFrame, keys=ADDRESS) -> DataFrame:
    """All versions with their number and the sequence that replaced them (null for the newest)."""
    w = Window.partitionBy(*keys).orderBy("sequence")
    return log.withColumn("version", F.row_number().over(w)).withColumn("replaced_by", F.lead("sequence").over(w))


def pivot_rows(cells: DataFrame, columns: list, row: list[str], column: str = "column_name", value: str = "value") -> DataFrame:
    """Wide rows from live cells with an explicit list of columns, so no extra job looks for them."""
    return cells.groupBy(*row).agg(*(F.max(F.when(F.col(column) == c, F.col(value))).alias(str(c)) for c in columns))


def row_maps(cells: DataFrame, row: list[str], column: str = "column_name", value: str = "value") -> DataFrame:
    """Rows as maps from column to value, for any set of columns."""
    return cells.groupBy(*row).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, value)))).alias("cells"))


def unpivot(table: DataFrame, row: list[str], columns: list[str]) -> DataFrame:
    """Cells from a wide table; the values are cast to strings, nulls are absent cells."""
    wide = table.select(*row, *(F.col(c).cast("string").alias(c) for c in columns))
    return wide.unpivot(row, columns, "column_name", "value").where("value is not null")


def merge_runs(*runs: DataFrame, keys=ADDRESS) -> DataFrame:
    """One version per key out of any number of runs: a union and the resolution; Spark's shuffle does the merging."""
    return latest(reduce(DataFrame.unionByName, runs), keys)


def live_bytes(log: DataFrame, by: list[str], key: Column, value: Column, keys=ADDRESS) -> DataFrame:
    """Bytes that a write buffer would hold: each key once, its newest value, none for tombstones."""
    newest = latest(log, keys)
    size = F.octet_length(key) + F.when(F.col("is_tombstone"), 0).otherwise(F.coalesce(F.octet_length(value), F.lit(0)))
    return newest.groupBy(*by).agg(F.sum(size).cast("bigint").alias("live_bytes"))

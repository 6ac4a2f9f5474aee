"""Replay of the log after a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_prefix(wal: DataFrame, valid: str = "valid") -> DataFrame:
    """The records of each segment before its first bad one; the segments are independent of each other."""
    w = Window.partitionBy("segment").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    return wal.withColumn("__ok", F.min(valid).over(w)).where("__ok").drop("__ok")


def first_bad(wal: DataFrame, valid: str = "valid") -> DataFrame:
    """(segment, bad_offset): by a partial aggregate instead of a window, for segments of any size."""
    return wal.where(~F.col(valid)).groupBy("segment").agg(F.min("offset").alias("bad_offset"))


def valid_prefix_by_join(wal: DataFrame, valid: str = "valid") -> DataFrame:
    """The same as valid_prefix() without a sort; one row a segment meets the records."""
    bad = first_bad(wal, valid)
    return wal.join(bad, "segment", "left").where("bad_offset is null or offset < bad_offset").drop("bad_offset")


def replayed(wal: DataFrame, active_segment: int) -> DataFrame:
    """The records of the segments before the active one."""
    return wal.where(F.col("segment") < active_segment)

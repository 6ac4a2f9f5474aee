"""Algebra of versions: which runs are live, which edits are stale, which files can go. On DataFrames of ids and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_at(edits: DataFrame, version: int | None = None) -> DataFrame:
    """(file_id) live after all edits up to a version; edits: (version, removed, added) with arrays of ids.

    The last edit that names a file decides; within one edit an addition comes after a removal.
    """
    upto = edits if version is None else edits.where(F.col("version") <= version)
    gone = upto.select("version", F.lit(0).alias("added"), F.explode("removed").alias("file_id"))
    come = upto.select("version", F.lit(1).alias("added"), F.explode("added").alias("file_id"))
    last = gone.union(come).groupBy("file_id").agg(F.max(F.struct("version", "added")).alias("last"))
    return last.where("last.added = 1").select("file_id")


def stale(edits_removed: DataFrame, current: DataFrame) -> DataFrame:
    """Ids that an edit removes although they are not live: any makes the edit stale as a whole."""
    return edits_removed.join(current, "file_id", "left_anti")


def apply_edit(current: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The live files after an edit; an added file replaces one of the same id."""
    return current.join(removed, "file_id", "left_anti").join(added.select("file_id"), "file_id", "left_anti").unionByName(added)


def live_ids(versions: DataFrame) -> DataFrame:
    """Distinct ids over the versions that somebody still reads; versions: (version, files)."""
    return versions.select(F.explode("files").alias("file_id")).distinct()


def reclaimable(pending: DataFrame, versions: DataFrame) -> DataFrame:
    """Obsolete files that no live version needs."""
    return pending.join(live_ids(versions), "file_id", "left_anti")

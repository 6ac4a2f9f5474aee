"""Compaction: which runs to merge, whether tombstones may go, and the merge itself."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ADDRESS
from .resolve import merge_runs


@dataclass(frozen=True)
class RunMeta:
    file_id: int
    size_bytes: int
    entry_count: int = 0
    min_sequence: int = 0
    max_sequence: int = 0
    min_key: bytes | None = None
    max_key: bytes | None = None
    path: str = ""


def entry_sum(runs: Sequence[RunMeta]) -> int:
    """Entries of all runs together: no merge of them has more keys, and a filter for its output is sized by it."""
    return sum(f.entry_count for f in runs)


@dataclass(frozen=True)
class Candidate:
    inputs: tuple[int, ...]
    can_drop_tombstones: bool


def can_drop_tombstones(live: Sequence[int], inputs: Sequence[int]) -> bool:
    """Whether the inputs are the oldest of the live runs, by id; never for no inputs, or for more than live."""
    return 0 < len(inputs) <= len(live) and sorted(live)[: len(inputs)] == sorted(inputs)


def can_drop_by_sequence(live: Sequence[RunMeta], inputs: Sequence[int]) -> bool:
    """The rule that stays right when old data sits in a run with a new id.

    Tombstones of the inputs may go if every other live run is newer than all of them or can't hold any of their keys.
    """
    chosen = [f for f in live if f.file_id in set(inputs)]
    if not chosen or len(chosen) != len(set(inputs)):
        return False
    newest = max(f.max_sequence for f in chosen)
    known = all(f.min_key is not None and f.max_key is not None for f in chosen)
    low, high = (min(f.min_key for f in chosen), max(f.max_key for f in chosen)) if known else (None, None)

    def apart(f: RunMeta) -> bool:
        return known and f.min_key is not None and f.max_key is not None and (f.max_key < low or f.min_key > high)

    return all(f.min_sequence > newest or apart(f) for f in live if f.file_id not in set(inputs))


class Policy(Protocol):
    name: str

    def pick(self, live: Sequence[RunMeta]) -> Candidate | None: ...


class FullCompaction:
    """All runs into one."""

    name = "full"

    def pick(self, live: Sequence[RunMeta]) -> Candidate | None:
        return Candidate(tuple(sorted(f.file_id for f in live)), True) if live else None


class SizeTiered:
    """Runs of like size: buckets by the running mean, of the full enough ones the one with the oldest run, its oldest runs."""

    name = "size_tiered"

    def __init__(self, min_width: int = 4, max_width: int = 8, low: float = 0.5, high: float = 1.5):
        if max_width < min_width:
            raise ValueError("max_width is below min_width")
        self.min_width, self.max_width, self.low, self.high = min_width, max_width, low, high

    def pick(self, live: Sequence[RunMeta]) -> Candidate | None:
        buckets: list[list[RunMeta]] = []
        mean = 0.0
        for f in sorted(live, key=lambda f: (f.size_bytes, f.file_id)):
            if not buckets or not self.low * mean <= f.size_bytes <= self.high * mean:
                buckets.append([])
            buckets[-1].append(f)
            mean = sum(x.size_bytes for x in buckets[-1]) / len(buckets[-1])
        wide = [sorted(f.file_id for f in b) for b in buckets if len(b) >= self.min_width]
        if not wide:
            return None
        inputs = min(wide)[: self.max_width]
        return Candidate(tuple(inputs), can_drop_tombstones([f.file_id for f in live], inputs))


def size_tier_pick(runs: Column, min_width: int, max_width: int, low: float = 0.5, high: float = 1.5) -> Column:
    """The size-tiered choice as an expression on an array of (file_id, size_bytes): the sorted input ids, null for none."""
    by_size = F.array_sort(F.transform(runs, lambda r: F.struct(r["size_bytes"].alias("s"), r["file_id"].alias("i"))))
    bucket = "struct<n:bigint,sum:double,ids:array<bigint>>"
    empty = F.from_json(F.lit("[]"), f"array<{bucket}>")

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        mean = last["sum"] / last["n"]
        size = r["s"].cast("double")
        joins = (F.size(acc) > 0) & (size >= low * mean) & (size <= high * mean)
        grown = F.struct((last["n"] + 1).alias("n"), (last["sum"] + size).alias("sum"), F.concat(last["ids"], F.array(r["i"])).alias("ids"))
        fresh = F.struct(F.lit(1).cast("bigint").alias("n"), size.alias("sum"), F.array(r["i"]).alias("ids"))
        return F.when(F.size(acc) == 0, F.array(fresh)).when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    found = F.aggregate(by_size, empty.cast(f"array<{bucket}>"), step, lambda acc: F.filter(acc, lambda b: b["n"] >= min_width))
    oldest = F.array_min(F.transform(found, lambda b: F.sort_array(b["ids"])))
    return F.slice(oldest, 1, max_width)


def can_drop_column(live: Column, inputs: Column) -> Column:
    n = F.size(inputs)
    return (n > 0) & (n <= F.size(live)) & (F.slice(F.sort_array(live), 1, F.greatest(n, F.lit(0))) == F.sort_array(inputs))


def compact(runs: Sequence[DataFrame], drop_tombstones: bool, keys=ADDRESS, ordered: bool = True) -> DataFrame:
    """The merged run; ``ordered``: dealt by ranges of the key and sorted, so that each of its files is a range of the key order."""
    merged = merge_runs(*runs, keys=keys)
    if drop_tombstones:
        merged = merged.where(~F.col("is_tombstone"))
    return merged.repartitionByRange(*keys).sortWithinPartitions(*keys) if ordered else merged


def run_stats(runs: DataFrame, by: str, key: Column, value: Column) -> DataFrame:
    """Entries, sequence range and logical bytes (17 a cell for its header) of each run."""
    size = F.sum(F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)) + 17)
    return runs.groupBy(by).agg(F.count("*").alias("entry_count"), F.min("sequence").alias("min_sequence"), F.max("sequence").alias("max_sequence"), size.cast("bigint").alias("logical_bytes"))

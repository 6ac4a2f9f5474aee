"""A durable store of cells: sorted Parquet runs, log segments, and a manifest of versions that are published by compare-and-swap.

All files are reached through Hadoop's file systems, so a store may live wherever Spark reads. Each version is one small JSON file,
and making the next one exclusively is the swap: of two writers one gets StaleVersion. Only what a version names exists. A run
or segment is written under a name of its own first and named by a version afterwards, so a crash at any point leaves the store as
it was, with an orphan that vacuum() removes.

A segment holds places within its batch, not sequence numbers; the version that takes it in says where its numbers and clock
begin. So a writer that loses the swap publishes the same files again on top of the newest version, and no two cells ever share a
number. Versions are kept for a while and longer if somebody pins them, whatever object or process that is.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadConfig, BadFile, BadMagic, OutOfRange, StaleVersion, StoreError
from ..functions.codec import encode_key
from ..functions.hashing import crc32c
from ..functions.hlc import Clock
from ..log import logger
from ..operators import mutations, resolve
from ..operators.compaction import Candidate, FullCompaction, Policy, RunMeta, SizeTiered, can_drop_by_sequence, compact, entry_sum
from ..schema import ADDRESS, CELL_LOG, RUN
from .files import Files
from .shared import literal_rows

FORMAT = "cellweave-version-2"
HOUR = 3_600_000
#: How often a batch is published again after another writer was faster.
TRIES = 50
#: Rows of a segment: its cells with their place in the batch.
PLACED = "partition_key binary, clustering_key binary, column_name binary, value binary, is_tombstone boolean, __at bigint"


@dataclass(frozen=True)
class Segment:
    """A batch of the log. parts: (part, place of its first row); a row's number is first_sequence + place, its clock alike."""

    name: str
    rows: int
    size_bytes: int
    parts: tuple[tuple[int, int], ...]
    first_sequence: int
    first_clock: int


@dataclass(frozen=True)
class Version:
    number: int = 0
    runs: tuple[RunMeta, ...] = ()
    segments: tuple[Segment, ...] = ()
    next_lsn: int = 1
    clock: int = 0
    next_file: int = 1

    def to_json(self, removed: list[int], added: list[int], made: int) -> str:
        hexed = lambda b: b.hex() if b is not None else None
        runs = [asdict(f) | {"min_key": hexed(f.min_key), "max_key": hexed(f.max_key)} for f in self.runs]
        body = json.dumps({"number": self.number, "removed": removed, "added": added, "next_lsn": self.next_lsn, "clock": self.clock, "next_file": self.next_file, "made": made, "runs": runs, "segments": [asdict(s) for s in self.segments]})
        return json.dumps({"format": FORMAT, "crc": crc32c(body.encode()), "body": body})

    @classmethod
    def from_json(cls, raw: bytes, name: str) -> tuple[Version, int]:
        """(version, milliseconds at which it was made); BadMagic for another format, BadConfig for a damaged file."""
        try:
            outer = json.loads(raw.decode())
            kind, crc, body = (outer[k] for k in ("format", "crc", "body"))
        except (ValueError, KeyError, TypeError) as e:
            raise BadMagic(f"{name} is no version file") from e
        if kind != FORMAT:
            raise BadMagic(f"{name} has the format {kind}")
        if crc32c(body.encode()) != crc:
            raise BadConfig(f"{name} is damaged")
        at = json.loads(body)
        raw_key = lambda x: bytes.fromhex(x) if x is not None else None
        runs = tuple(RunMeta(**(r | {"min_key": raw_key(r["min_key"]), "max_key": raw_key(r["max_key"])})) for r in at["runs"])
        segments = tuple(Segment(**(s | {"parts": tuple(map(tuple, s["parts"]))})) for s in at["segments"])
        return cls(at["number"], runs, segments, at["next_lsn"], at["clock"], at["next_file"]), at["made"]


def _file(number: int) -> str:
    return f"versions/v{number:020d}.json"


class Snapshot:
    """A pinned version: its runs and segments stay readable, for every process, until it is released or the pin expires."""

    def __init__(self, store: Store, version: Version, pin: str):
        self.store, self.at, self.pin, self.version = store, version, pin, version.number

    def files(self) -> list[RunMeta]:
        return list(self.at.runs)

    def log(self) -> DataFrame:
        return self.store._all(self.at, self.at.runs).drop("hlc_ts")

    def live(self) -> DataFrame:
        return resolve.live(self.log())

    def _near(self, key: tuple) -> DataFrame:
        return self.store._all(self.at, _may_hold(self.at.runs, key)).drop("hlc_ts")

    def get(self, *key: bytes) -> DataFrame:
        """Runs whose key range can't hold the key are left out before the scan."""
        return resolve.get(self._near(key), *key)

    def get_raw(self, *key: bytes) -> DataFrame:
        return resolve.get_raw(self._near(key), *key)

    def release(self) -> None:
        self.store.files.delete(self.pin)


def _encoded(key: tuple) -> bytes:
    return b"".join(bytes(b).replace(b"\x00", b"\x00\xff") + b"\x00\x01" for b in key)


def _may_hold(runs: tuple[RunMeta, ...], key: tuple) -> list[RunMeta]:
    """The runs whose key range reaches the key, or the prefix if the key has only its first parts."""
    at = _encoded(key)
    return [f for f in runs if f.min_key is None or f.min_key[: len(at)] <= at <= f.max_key]


class Store:
    """Open with :meth:`open`. Batches of mutations are appended to the log, flushed to runs, and compacted by a policy."""

    def __init__(self, spark: SparkSession, root: str, flush_bytes: int, policy: Policy | None):
        self.spark, self.root, self.flush_bytes = spark, root.rstrip("/"), flush_bytes
        self.files = Files(spark, self.root)
        self.policy: Policy = policy or SizeTiered()
        self.at = Version()
        self._compacting = True
        self.clock = Clock()

    @classmethod
    def open(cls, spark: SparkSession, root: str, flush_bytes: int = 64 << 20, policy: Policy | None = None, recover: bool = True) -> Store:
        """Opens or makes a store. Every run of the newest version must be there in its size, or opening fails as a whole.

        recover: what the log still has is flushed, with its sequence numbers, as after a crash. That is safe beside another
        writer, whose next flush then finds less to do; its files stay until vacuum().
        """
        if not root or not root.strip():
            raise BadConfig("a store needs a folder")
        store = cls(spark, root.strip(), flush_bytes, policy)
        for name in ("versions", "runs", "log", "pins", "_drafts"):
            store.files.make(name)
        store.refresh()
        for run in store.at.runs:
            store.check(run.file_id, deep=False)
        if recover:
            store.flush()
        return store

    # Versions

    @property
    def version(self) -> int:
        return self.at.number

    @property
    def runs(self) -> list[RunMeta]:
        return list(self.at.runs)

    def _numbers(self) -> list[int]:
        return [int(n[1:-5]) for n in self.files.names("versions") if n.startswith("v") and n.endswith(".json")]

    def _load(self, number: int) -> Version:
        return Version.from_json(self.files.read(_file(number)), _file(number))[0]

    def refresh(self) -> Version:
        """Moves to the newest version; without a listing of all versions while the known one is the newest."""
        if self.at.number and self.files.exists(_file(self.at.number)) and not self.files.exists(_file(self.at.number + 1)):
            return self.at
        numbers = self._numbers()
        self.at = self._load(max(numbers)) if numbers else Version()
        return self.at

    def _publish(self, removed: list[int], added: list[RunMeta], **changes) -> Version:
        """The whole edit or nothing: it must follow the version that this store knows, and remove live runs only."""
        gone = set(removed)
        if gone - {f.file_id for f in self.at.runs}:
            raise StaleVersion("the edit removes a run that is not live")
        runs = [f for f in self.at.runs if f.file_id not in gone | {a.file_id for a in added}] + added
        state = {"number": self.at.number + 1, "runs": tuple(sorted(runs, key=lambda f: f.file_id)), "next_file": max([self.at.next_file, *(f.file_id + 1 for f in added)])}
        new = Version(**(self.at.__dict__ | changes | state))
        if not self.files.create(_file(new.number), new.to_json(sorted(gone), [f.file_id for f in added], time.time_ns() // 1_000_000)):
            raise StaleVersion(f"version {new.number} was published by another writer")
        self.at = new
        logger("sstable").info("version %d: %d runs, %d segments", new.number, len(new.runs), len(new.segments))
        return new

    def _retried(self, edit: Callable[[], object]):
        """The edit on the newest version, again on the next one whenever another writer was faster."""
        for k in range(TRIES):
            try:
                return edit()
            except StaleVersion:
                if k == TRIES - 1:
                    raise
                logger("general").warning("version %d was published by another writer; trying again", self.at.number + 1)
                self.refresh()

    def snapshot(self, version: int | None = None, keep_ms: int = 24 * HOUR) -> Snapshot:
        """Pins the newest version, or an older one that is still kept; the pin lasts keep_ms unless it is released.

        The pin is written before the version is looked at again, and vacuum() looks at the pins again after it has taken versions
        away: so a version that was pinned in between is either kept or refused here with StaleVersion.
        """
        number = self.refresh().number if version is None else version
        pin = f"pins/{number:020d}-{uuid.uuid4().hex}"
        self.files.create(pin, str(time.time_ns() // 1_000_000 + keep_ms))
        if number and not self.files.exists(_file(number)):
            self.files.delete(pin)
            raise StaleVersion(f"version {number} is not kept any more")
        return Snapshot(self, self._load(number) if number else Version(), pin)

    # Data

    def _runs(self, runs) -> DataFrame:
        empty = self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in RUN))
        return self.spark.read.schema(RUN).parquet(*(f"{self.root}/{f.path}" for f in runs)) if runs else empty

    def _segments(self, segments) -> DataFrame:
        """The rows of segments with their numbers: one read, and a table of (segment, part) joined to it."""
        if not segments:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in CELL_LOG))
        firsts = [{"segment": s.name, "part": p, "seq": s.first_sequence + at, "clk": s.first_clock + at} for s in segments for p, at in s.parts]
        starts = literal_rows(self.spark, firsts, "segment string, part bigint, seq bigint, clk bigint")
        rows = self.spark.read.schema(PLACED).parquet(*(f"{self.root}/log/{s.name}" for s in segments))
        rows = rows.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"/log/([^/]+)/", 1)).withColumn("part", F.shiftright("__at", 33))
        starts = F.broadcast(starts) if len(firsts) <= 200_000 else starts
        row = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
        return rows.join(starts, ["segment", "part"]).select(*ADDRESS, "value", "is_tombstone", (F.col("seq") + row).alias("sequence"), (F.col("clk") + row).alias("hlc_ts"))

    def _all(self, at: Version, runs) -> DataFrame:
        old = self._runs(runs).withColumn("hlc_ts", F.lit(None).cast("bigint"))
        return old.unionByName(self._segments(at.segments)) if at.segments else old

    def log(self) -> DataFrame:
        """All stored versions: runs and log."""
        at = self.refresh()
        return self._all(at, at.runs).drop("hlc_ts")

    def unflushed(self) -> DataFrame:
        """The mutations of the log alone, each with its sequence and clock."""
        return self._segments(self.refresh().segments)

    def latest(self) -> DataFrame:
        return resolve.latest(self.log())

    def live(self) -> DataFrame:
        return resolve.live(self.log())

    def _near(self, key: tuple) -> DataFrame:
        at = self.refresh()
        return self._all(at, _may_hold(at.runs, key)).drop("hlc_ts")

    def get(self, *key: bytes) -> bytes | None:
        row = resolve.get(self._near(key), *key).first()
        return None if row is None else bytes(row["value"])

    def get_internal(self, *key: bytes):
        """The newest version with its sequence, which may be a tombstone; None if there is none."""
        return resolve.get_raw(self._near(key), *key).first()

    def scan(self, partition: bytes) -> DataFrame:
        """The live cells of a partition in key order; runs that don't reach its keys are not read."""
        return resolve.partition_scan(self._near((partition,)), partition)

    def run_scan(self, file_id: int) -> DataFrame:
        """Every cell of one run in key order, tombstones included. The files of a run are ranges of the key order already."""
        return self._runs([self._run(file_id)]).orderBy(*ADDRESS)

    def _run(self, file_id: int) -> RunMeta:
        found = [f for f in self.at.runs if f.file_id == file_id]
        if not found:
            raise BadConfig(f"run {file_id} is not live")
        return found[0]

    def latest_lsn(self) -> int:
        """The number that the next mutation gets."""
        return self.refresh().next_lsn

    def check(self, file_id: int, deep: bool = True) -> RunMeta:
        """Whether a run is what its version says: BadFile if it is missing, BadConfig in another size; with ``deep``, BadMagic for
        a file that is not Parquet and OutOfRange if the files don't hold the run's number of entries."""
        run = self._run(file_id)
        if not self.files.exists(run.path):
            raise BadFile(f"run {file_id} is missing")
        if (size := self.files.size(run.path)) != run.size_bytes:
            raise BadConfig(f"run {file_id} has {size} bytes instead of {run.size_bytes}")
        if deep:
            for name, size, _ in self.files.listing(run.path):
                if name.endswith(".parquet") and (size < 12 or self.files.read_at(f"{run.path}/{name}", size - 4, 4) != b"PAR1"):
                    raise BadMagic(f"{run.path}/{name} is no Parquet file")
            if (n := self._runs([run]).count()) != run.entry_count:
                raise OutOfRange(f"run {file_id} has {n} entries instead of {run.entry_count}")
        return run

    # Mutations

    def put(self, partition: bytes, clustering: bytes, column: bytes, value: bytes) -> None:
        if not value:
            raise BadConfig("a put needs a value")
        self.write(self._one(partition, clustering, column, value, False), F.lit(0))

    def remove(self, partition: bytes, clustering: bytes, column: bytes) -> None:
        self.write(self._one(partition, clustering, column, None, True), F.lit(0))

    def _one(self, partition: bytes, clustering: bytes, column: bytes, value: bytes | None, dead: bool) -> DataFrame:
        cells = [F.lit(bytearray(x)).alias(c) for c, x in zip(ADDRESS, (partition, clustering, column), strict=True)]
        return self.spark.range(1).select(*cells, (F.lit(None) if value is None else F.lit(bytearray(value))).cast("binary").alias("value"), F.lit(dead).alias("is_tombstone"))

    def write(self, batch: DataFrame, order) -> int:
        """Appends a batch of mutations to the log in the given order; returns its number of mutations.

        batch: partition_key, clustering_key, column_name, value, is_tombstone, and what ``order`` needs. The batch is one
        segment: all of it is there once a version names it, and nothing before. Mutations that are equal in ``order`` go by their
        address, then tombstones first, then by value.
        """
        name = uuid.uuid4().hex
        rows = mutations.placed(mutations.checked(batch), order, [*ADDRESS, F.col("is_tombstone").desc(), "value"], "__at")
        try:
            rows.select(*ADDRESS, "value", "is_tombstone", "__at").write.parquet(f"{self.root}/log/{name}")
        except (PySparkException, Py4JJavaError) as e:
            self.files.delete(f"log/{name}")
            if mutations.NO_VALUE in str(e):
                raise BadConfig(mutations.NO_VALUE) from e
            raise
        size = sum(F.octet_length(c) for c in ADDRESS) + F.coalesce(F.octet_length("value"), F.lit(0))
        sums = self.spark.read.schema(PLACED).parquet(f"{self.root}/log/{name}").groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count("*").alias("n"), F.sum(size).alias("b")).orderBy("p").collect()
        n, parts = 0, []
        for r in sums:  # one row a task of the batch
            parts.append((r["p"], n))
            n += r["n"]
        if not n:
            self.files.delete(f"log/{name}")
            return 0
        made = Segment(name, n, sum(r["b"] for r in sums), tuple(parts), 0, 0)
        self._retried(lambda: self._append(made))
        logger("wal").info("segment %s: %d mutations, %d bytes", name, n, made.size_bytes)
        if sum(s.size_bytes for s in self.at.segments) >= self.flush_bytes and self._buffered() >= self.flush_bytes:
            self.flush()
        return n

    def _append(self, made: Segment) -> None:
        self.clock.last = max(self.clock.last, self.at.clock)
        first = self.clock.next()
        segment = Segment(made.name, made.rows, made.size_bytes, made.parts, self.at.next_lsn, first)
        self._publish([], [], segments=(*self.at.segments, segment), next_lsn=self.at.next_lsn + made.rows, clock=first + made.rows - 1)
        self.clock.last = self.at.clock

    def _buffered(self) -> int:
        """Bytes of the log's newest versions, each key once; asked for only when all versions together reach the limit."""
        key = encode_key(*(F.col(c) for c in ADDRESS))
        row = resolve.live_bytes(self._segments(self.at.segments), [], key, F.col("value")).first()
        return int(row[0] or 0) if row else 0

    def _write_run(self, rows: DataFrame) -> RunMeta:
        """Rows dealt out by key ranges and sorted, with Bloom filters on the parts of the key; named by nothing yet."""
        new = self.at.next_file
        path = f"runs/{new:08d}-{uuid.uuid4().hex}"
        writer = rows.select(*RUN.names).repartitionByRange(*ADDRESS).sortWithinPartitions(*ADDRESS).write
        for c in ADDRESS:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{path}")
        key = encode_key(*(F.col(c) for c in ADDRESS))
        n, low, high, first, last = self.spark.read.schema(RUN).parquet(f"{self.root}/{path}").agg(F.count("*"), F.min("sequence"), F.max("sequence"), F.min(key), F.max(key)).first()
        as_bytes = lambda b: None if b is None else bytes(b)
        return RunMeta(new, self.files.size(path), n, low or 0, high or 0, as_bytes(first), as_bytes(last), path)

    def flush(self) -> bool:
        """The log's newest versions become a run; False if there is nothing to flush. If another writer flushed the same segments
        meanwhile, what it left is tried again."""
        for _ in range(TRIES):
            segments = self.refresh().segments
            if not segments:
                return False
            began = self.at
            run = self._write_run(resolve.latest(self._segments(segments).drop("hlc_ts")))
            try:
                self._publish([], [run], segments=())
            except StaleVersion:
                self.refresh()
                if set(segments) <= set(self.at.segments) and self.at.next_file == began.next_file:
                    try:  # others only appended to the log: the run is still right
                        self._publish([], [run], segments=tuple(s for s in self.at.segments if s not in segments))
                    except StaleVersion:
                        continue
                else:
                    continue
            logger("memtable").info("flushed %d segments to run %d: %d entries", len(segments), run.file_id, run.entry_count)
            if self._compacting:
                self.compact()
            return True
        raise StaleVersion("other writers were always faster")

    # Compaction

    def set_compaction_policy(self, policy: Policy | None) -> None:
        if policy is None:
            raise BadConfig("a compaction policy is needed")
        self.policy = policy

    def compact(self, policy: Policy | None = None) -> RunMeta | None:
        """Merges what the policy picks of the version that this store knows; None if it picks nothing or another writer was faster.
        After that, this store knows the newest version."""
        picked = (policy or self.policy).pick(self.runs)
        return self._compact(picked) if picked else None

    def compact_now(self) -> RunMeta | None:
        self.refresh()
        return self.compact(FullCompaction())

    def _compact(self, picked: Candidate) -> RunMeta | None:
        inputs = list(picked.inputs)
        chosen = [f for f in self.at.runs if f.file_id in inputs]
        drop = can_drop_by_sequence(self.runs, inputs)  # what the log has is newer than any run
        run = self._write_run(compact([self._runs(chosen)], drop, ordered=False))
        try:
            self._publish(inputs, [run])
        except StaleVersion:
            logger("compaction").warning("the merge of %s came too late", inputs)
            self.refresh()
            return None
        logger("compaction").info("merged %s with %d entries at most into run %d with %d%s", inputs, entry_sum(chosen), run.file_id, run.entry_count, ", tombstones dropped" if drop else "")
        return run

    def vacuum(self, retain_ms: int = HOUR, grace_ms: int = HOUR) -> list[str]:
        """Deletes versions that are neither the newest, nor pinned, nor younger than retain_ms, then what only they name; returns
        the names of the runs and segments that went.

        What no version ever named may be the work of a writer that has not published yet; it goes when it is older than grace_ms.
        """
        now = time.time_ns() // 1_000_000
        numbers = sorted(self._numbers())
        if not numbers:
            return []
        known = {n: Version.from_json(self.files.read(_file(n)), _file(n)) for n in numbers}
        # a version is of use until its successor is retain_ms old
        ended = {n: known[m][1] for n, m in zip(numbers, numbers[1:], strict=False)}
        gone = [n for n in numbers[:-1] if ended[n] + retain_ms <= now and n not in self._pinned(now)]
        texts = {n: self.files.read(_file(n)) for n in gone}
        for n in gone:
            self.files.delete(_file(n))
        for n in set(gone) & self._pinned(now):  # pinned since the first look
            self.files.create(_file(n), texts[n].decode())
            gone.remove(n)
        newest = max(self._numbers())
        kept = [known[n][0] if n in known else self._load(n) for n in self._numbers() if n <= newest]
        needed = {f.path for v in kept for f in v.runs} | {f"log/{s.name}" for v in kept for s in v.segments}
        once = {f.path for v, _ in known.values() for f in v.runs} | {f"log/{s.name}" for v, _ in known.values() for s in v.segments}
        out = []
        for folder in ("runs", "log"):
            for name, _, changed in self.files.listing(folder):
                path = f"{folder}/{name}"
                if path not in needed and (path in once or changed + grace_ms <= now):
                    self.files.delete(path)
                    out.append(path)
        if out:
            logger("io").info("vacuum removed %d runs and segments and %d versions", len(out), len(gone))
        return out

    def _pinned(self, now: int) -> set[int]:
        """The pinned versions; pins that have expired are removed."""
        out = set()
        for name in self.files.names("pins"):
            try:
                until = int(self.files.read(f"pins/{name}"))
            except StoreError:  # released meanwhile
                continue
            if until <= now:
                self.files.delete(f"pins/{name}")
            else:
                out.add(int(name.split("-")[0]))
        return out


ENGINES: dict[str, type[Store]] = {"cells": Store}


def register_engine(name: str, engine: type[Store]) -> None:
    ENGINES[name] = engine


def create_engine(name: str, spark: SparkSession, root: str, **options) -> Store:
    if name not in ENGINES:
        raise BadConfig(f"no engine {name}")
    return ENGINES[name].open(spark, root, **options)

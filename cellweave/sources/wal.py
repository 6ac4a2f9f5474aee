"""The binary log format: big-endian records with a CRC-32C, read and written through Spark.

``body_len u32 | crc u32 | op u8 | clock u64 | sequence u64 | key_len u32 | key | value_len u32 | value``
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadConfig, EndOfLog, OutOfRange
from ..functions.codec import decode_key, encode_key, parse_log_file_name
from ..schema import ADDRESS
from .files import Files
from ..functions.hashing import crc32c, crc32c_batch

PUT, DELETE = 1, 2
_HEAD, _FIXED = struct.Struct(">II"), struct.Struct(">BQQ")
LEAST = _HEAD.size + _FIXED.size + 8


def _framed(body: bytes, crc: int) -> bytes:
    return _HEAD.pack(len(body), crc) + body


def _body(op: int, clock: int, sequence: int, key: bytes, value: bytes) -> bytes:
    return _FIXED.pack(op, clock, sequence) + struct.pack(">I", len(key)) + key + struct.pack(">I", len(value)) + value


def encode_record(op: int, clock: int, sequence: int, key: bytes, value: bytes) -> bytes:
    body = _body(op, clock, sequence, key, value)
    return _framed(body, crc32c(body))


def decode_record(raw: bytes, at: int = 0) -> tuple[int, int, int, bytes, bytes, int]:
    """(op, clock, sequence, key, value, place after the record)."""
    if len(raw) - at < LEAST:
        raise OutOfRange("the buffer ends before a whole record")
    size, crc = _HEAD.unpack_from(raw, at)
    body = raw[at + _HEAD.size : at + _HEAD.size + size]
    if len(body) < size or size < LEAST - _HEAD.size or crc32c(body) != crc:
        raise BadConfig("damaged log record")
    op, clock, sequence = _FIXED.unpack_from(body)
    start = _FIXED.size + 4
    n = int.from_bytes(body[_FIXED.size : start], "big")
    m = int.from_bytes(body[start + n : start + n + 4], "big")
    value = body[start + n + 4 : start + n + 4 + m]
    if op not in (PUT, DELETE) or start + n + 4 + m != size or len(value) != m:
        raise BadConfig("damaged log record")
    return op, clock, sequence, body[start : start + n], value, at + _HEAD.size + size


class RecordReader:
    """One record after the other; EndOfLog at the end, and where less than a record is left."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def next(self) -> tuple[int, int, int, bytes, bytes]:
        if len(self.raw) - self.at < _HEAD.size or int.from_bytes(self.raw[self.at : self.at + 4], "big") < LEAST - _HEAD.size:
            raise EndOfLog("no further record")
        *record, self.at = decode_record(self.raw, self.at)
        return tuple(record)


RECORD_SQL = "segment bigint, offset bigint, op_type tinyint, hlc_ts bigint, sequence bigint, key binary, value binary, valid boolean"
_RECORD = pa.schema([("segment", pa.int64()), ("offset", pa.int64()), ("op_type", pa.int8()), ("hlc_ts", pa.int64()), ("sequence", pa.int64()), ("key", pa.binary()), ("value", pa.binary()), ("valid", pa.bool_())])
#: Records that are checked and handed on together.
_TOGETHER = 10_000


def _records(segment: int, raw: bytes) -> Iterator[pa.RecordBatch]:
    """The records of one segment up to the first damaged one. Their borders come from their sizes; the sums are checked in batches."""
    at, more = 0, True
    while more:
        rows, sums, bodies = [], [], []
        while len(rows) < _TOGETHER:
            size = int.from_bytes(raw[at : at + 4], "big")
            if len(raw) - at < _HEAD.size or size < LEAST - _HEAD.size:
                more = False
                break
            body = raw[at + _HEAD.size : at + _HEAD.size + size]
            op, clock, sequence = _FIXED.unpack_from(body) if len(body) >= LEAST - _HEAD.size else (0, 0, 0)
            start = _FIXED.size + 4
            n = int.from_bytes(body[_FIXED.size : start], "big")
            m = int.from_bytes(body[start + n : start + n + 4], "big")
            whole = len(body) == size and op in (PUT, DELETE) and start + n + 4 + m == size
            rows.append((segment, at, op, clock, sequence, body[start : start + n], body[start + n + 4 :], whole))
            sums.append(int.from_bytes(raw[at + 4 : at + 8], "big"))
            bodies.append(body)
            at += _HEAD.size + size
            if not whole:
                more = False
                break
        for i, (found, want) in enumerate(zip(crc32c_batch(bodies), sums, strict=True)):
            if found != want or not rows[i][7]:
                rows[i:] = [(segment, rows[i][1], None, None, None, None, None, False)]
                more = False
                break
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)


def read_segments(spark: SparkSession, path: str, active: int | None = None) -> DataFrame:
    """All records of the segments below a folder; after a damaged one there is a row with ``valid`` false and nothing else.

    A segment is one task's work, as its records can only be found one after the other; write_segments() bounds its size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    files = files.select(parse_log_file_name(F.col("path")).alias("segment"), "content").where("segment is not null")
    if active is not None:
        files = files.where(F.col("segment") < active)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _records(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())

    return files.mapInArrow(work, RECORD_SQL)


def write_segments(log: DataFrame, path: str, first: int = 1, rows: int = 100_000) -> list[str]:
    """Writes rows of the cell log as binary segments of at most ``rows`` records, in the order of their sequence; returns their names.

    Sequences must be distinct. Segment ``first + k`` has the sequences from ``k * rows`` on, counted from the least one; segments
    are made in parallel, each by one task. Spark writes each as one value to a folder of its own, and the driver gives the file
    its name by a rename: a segment is there as a whole or not at all.
    """
    spark = log.sparkSession
    least = log.agg(F.min("sequence")).first()[0]
    if least is None:
        return []
    number = (F.floor((F.col("sequence") - least) / rows) + first).cast("bigint")
    key = encode_key(*(F.col(c) for c in ADDRESS))
    put = F.when(F.col("is_tombstone"), DELETE).otherwise(PUT)
    cells = log.select(number.alias("segment"), "sequence", F.coalesce("hlc_ts", F.lit(0)).alias("hlc_ts"), put.alias("op"), key.alias("key"), F.coalesce("value", F.lit(b"")).alias("value"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        one = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["segment", "content"])
        for batch in batches:
            columns = batch.to_pydict()
            bodies = [_body(*r) for r in zip(*(columns[c] for c in ("op", "hlc_ts", "sequence", "key", "value")), strict=True)]
            for segment, body, crc in zip(columns["segment"], bodies, crc32c_batch(bodies), strict=True):
                if segment != now:
                    if parts:
                        yield one()
                    now, parts = segment, []
                parts.append(_framed(body, crc))
        if parts:
            yield one()

    dealt = cells.repartitionByRange("segment").sortWithinPartitions("segment", "sequence")
    files = Files(spark, path)
    draft = "_writing"
    # the line end is the one byte after the last record, which readers take for the end of the segment
    dealt.mapInArrow(work, "segment bigint, content binary").select("segment", F.col("content").cast("string")).write.mode("overwrite").partitionBy("segment").text(f"{path.rstrip('/')}/{draft}")
    out = []
    for folder in files.names(draft):
        if folder.startswith("segment="):
            name = f"wal_{int(folder[8:]):08d}.log"
            part = next(n for n in files.names(f"{draft}/{folder}") if n.startswith("part-"))
            files.rename(f"{draft}/{folder}/{part}", name)
            out.append(name)
    files.delete(draft)
    return sorted(out)


def to_log(records: DataFrame) -> DataFrame:
    """Records as rows of the cell log."""
    parts = decode_key(F.col("key"))
    dead = F.col("op_type") == DELETE
    return records.where("valid").select(parts["partition_key"].alias("partition_key"), parts["clustering_key"].alias("clustering_key"), parts["column_name"].alias("column_name"), F.when(~dead, F.col("value")).alias("value"), dead.alias("is_tombstone"), "sequence", "hlc_ts")

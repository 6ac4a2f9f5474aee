"""Schemas of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"BINARY": T.BinaryType(), "BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "TINYINT": T.ByteType()}


def _columns(ddl: str) -> T.StructType:
    """As StructType.fromDDL(), which needs a session and so can't run when modules are imported."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(","))])


#: The append-only log of cells; keys and values are bytes, a tombstone has no value.
CELL_LOG = _columns("partition_key BINARY, clustering_key BINARY, column_name BINARY, value BINARY, is_tombstone BOOLEAN, sequence BIGINT, hlc_ts BIGINT")
#: A sorted run.
RUN = _columns("partition_key BINARY, clustering_key BINARY, column_name BINARY, value BINARY, is_tombstone BOOLEAN, sequence BIGINT")
#: What the manifest knows of a run.
FILES = _columns("file_id BIGINT, size_bytes BIGINT, entry_count BIGINT, min_sequence BIGINT, max_sequence BIGINT, min_key BINARY, max_key BINARY")
#: Log records as stored.
WAL = _columns("segment BIGINT, offset BIGINT, op_type TINYINT, hlc_ts BIGINT, sequence BIGINT, key BINARY, value BINARY")

ADDRESS = ("partition_key", "clustering_key", "column_name")
VERSION = ("value", "is_tombstone", "sequence")

"""Scalar codecs as column expressions: ordered composite keys, big-endian integers, file names, trimming, sizes.

All of them are built-in functions inside whole-stage code generation, but for the CRC of :mod:`cellweave.functions.hashing`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that configuration values are trimmed of.
BLANKS = " \t\n\r\u000c\u000b"


#: Bytes as characters, one to one, so that text functions work on bytes.
_BYTES = "ISO-8859-1"
_ZERO, _ESCAPED, _END = "\x00", "\x00\xff", "\x00\x01"


def _field(b: Column) -> Column:
    return F.concat(F.replace(F.decode(b, _BYTES), F.lit(_ZERO), F.lit(_ESCAPED)), F.lit(_END))


def encode_key(partition: Column, clustering: Column, column: Column) -> Column:
    """One binary key whose unsigned byte order is the order of the three parts: zero bytes are escaped, fields end with 00 01."""
    return F.encode(F.concat(_field(partition), _field(clustering), _field(column)), _BYTES)


def _parts(key: Column) -> Column:
    return F.split(F.decode(key, _BYTES), _END)


def _valid(parts: Column) -> Column:
    clean = lambda p: ~F.replace(p, F.lit(_ESCAPED), F.lit("")).contains(_ZERO)
    return (F.size(parts) >= 4) & clean(F.get(parts, 0)) & clean(F.get(parts, 1)) & clean(F.get(parts, 2))


def _once(parts: Column, use) -> Column:
    """``use`` of the parts, which are bound to a variable: they are made once, however often they are used."""
    return F.get(F.transform(F.array(parts), use), 0)


def key_is_valid(key: Column) -> Column:
    """False for truncated keys, keys with fewer than three fields, and zero bytes that are followed by anything but FF or 01."""
    return F.coalesce(_once(_parts(key), _valid), F.lit(False))


def decode_key(key: Column) -> Column:
    """Struct of the three parts, null for a malformed key; bytes after the third field are ignored."""
    one = lambda p, i: F.encode(F.replace(F.get(p, i), F.lit(_ESCAPED), F.lit(_ZERO)), _BYTES)
    return _once(_parts(key), lambda p: F.when(_valid(p), F.struct(one(p, 0).alias("partition_key"), one(p, 1).alias("clustering_key"), one(p, 2).alias("column_name"))))


def encode_uint(value: Column, size: int) -> Column:
    """Big-endian bytes of a non-negative number; null if it needs more than ``size`` bytes (1, 2, 4 or 8)."""
    digits = F.conv(value.cast("string"), 10, 16)
    return F.when((value >= 0) & (F.length(digits) <= 2 * size), F.unhex(F.lpad(digits, 2 * size, "0")))


def decode_uint(raw: Column, offset: int = 0, size: int = 8) -> Column:
    """The number in ``size`` big-endian bytes at an offset; DECIMAL(20,0) for 8 bytes, BIGINT otherwise; null if out of range."""
    number = F.conv(F.hex(F.substring(raw, offset + 1, size)), 16, 10).cast("decimal(20,0)" if size == 8 else "bigint")
    return F.when(F.octet_length(raw) >= offset + size, number)


def run_file_name(file_id: Column) -> Column:
    return F.format_string("sst_%08d.db", file_id)


def log_file_name(segment: Column) -> Column:
    return F.format_string("wal_%08d.log", segment)


def parse_run_file_name(path: Column) -> Column:
    """The id in a run's file name, 0 for any other name or an id beyond 63 bits."""
    return F.coalesce(F.regexp_extract(path, r"(?:^|[/\\])sst_([0-9]+)\.db$", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_log_file_name(path: Column) -> Column:
    """The segment in a log's file name, null for any other name."""
    return F.regexp_extract(path, r"(?:^|[/\\])wal_([0-9]+)\.log$", 1).try_cast("bigint")


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def to_text(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def to_bytes(text: Column) -> Column:
    return F.encode(text.cast("string"), "UTF-8")


def mib_to_bytes(mib: Column) -> Column:
    return mib * 1048576


def bytes_to_mib(size: Column) -> Column:
    return F.shiftright(size.cast("bigint"), 20)

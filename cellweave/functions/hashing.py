"""CRC-32C, a seeded 32-bit hash, and the Bloom filter over it. Spark has none of these, so they run in Arrow batches.

They are needed for exact formats and false-positive figures only; the store's runs have Parquet's own Bloom filters.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POLYNOMIAL = 0x82F63B78
SEEDS = (0xBC9F1D34, 0x6C8E9CF5)
_WORD = 0xFFFFFFFF


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (_POLYNOMIAL if n & 1 else 0)
        table.append(n)
    return table


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    """Castagnoli's CRC-32; crc32c(b"123456789") is 0xE3069283."""
    c = _WORD
    for b in data:
        c = _TABLE[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ _WORD


#: Bytes of a value up to which a batch is worked on place by place, all values at once.
_TOGETHER = 512


def crc32c_batch(values: list[bytes]) -> list[int]:
    """The sums of many values: numpy steps over the places of short ones, byte by byte for the rest of long ones."""
    sizes = np.array([len(v) for v in values], np.int64)
    flat, starts = np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    table, c = np.array(_TABLE, np.uint32), np.full(len(values), _WORD, np.uint32)
    for place in range(min(int(sizes.max(initial=0)), _TOGETHER)):
        on = np.flatnonzero(sizes > place)
        c[on] = table[(c[on] ^ flat[starts[on] + place]) & 0xFF] ^ (c[on] >> np.uint32(8))
    out = c.tolist()
    for i in np.flatnonzero(sizes > _TOGETHER).tolist():
        for b in values[i][_TOGETHER:]:
            out[i] = _TABLE[(out[i] ^ b) & 0xFF] ^ (out[i] >> 8)
    return [x ^ _WORD for x in out]


@F.pandas_udf(T.LongType())
def crc32c_column(data: pd.Series) -> pd.Series:
    sums = iter(crc32c_batch([bytes(b) for b in data if b is not None]))
    return pd.Series([None if b is None else next(sums) for b in data], dtype="Int64")


def hash32(data: bytes, seed: int) -> int:
    """Seeded 32-bit multiplicative hash over big-endian words and a little-endian rest."""
    factor = 0xC6A4A793
    h = seed ^ (len(data) * factor & _WORD)
    whole = len(data) & ~3
    for word in np.frombuffer(data[:whole], ">u4").tolist():
        h = (h + word) * factor & _WORD
        h ^= h >> 16
    if rest := data[whole:]:
        h = (h + int.from_bytes(rest, "little")) * factor & _WORD
        h ^= h >> 24
    return h


def hash32_batch(values: list[bytes], seed: int) -> np.ndarray:
    """hash32() of many values; those of one length are worked on word by word, all at once."""
    out = np.zeros(len(values), np.uint32)
    sizes = np.array([len(v) for v in values], np.int64)
    factor = np.uint32(0xC6A4A793)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        data = np.frombuffer(b"".join(values[i] for i in rows.tolist()), np.uint8).reshape(len(rows), n)
        h = np.full(len(rows), seed ^ (n * 0xC6A4A793 & _WORD), np.uint32)
        whole = n & ~3
        words = np.ascontiguousarray(data[:, :whole]).view(">u4").astype(np.uint32)
        for k in range(whole // 4):
            h = (h + words[:, k]) * factor
            h ^= h >> np.uint32(16)
        if n > whole:
            rest = np.zeros(len(rows), np.uint32)
            for k in range(n - whole):
                rest |= data[:, whole + k].astype(np.uint32) << np.uint32(8 * k)
            h = (h + rest) * factor
            h ^= h >> np.uint32(24)
        out[rows] = h
    return out


def _some(data: pd.Series) -> tuple[np.ndarray, list[bytes]]:
    """Where values are, and the values."""
    at = np.flatnonzero(data.notna().to_numpy())
    return at, [bytes(data.iloc[i]) for i in at.tolist()]


@F.pandas_udf(T.LongType())
def hash32_column(data: pd.Series, seed: pd.Series) -> pd.Series:
    at, values = _some(data)
    out = pd.Series([None] * len(data), dtype="Int64")
    seeds = seed.to_numpy()[at]
    for s in np.unique(seeds).tolist():
        own = np.flatnonzero(seeds == s)
        out.iloc[at[own]] = hash32_batch([values[i] for i in own.tolist()], int(s)).astype(np.int64)
    return out


class BloomFilter:
    """Double hashing over a bit array sized for a number of keys and a false-positive rate."""

    def __init__(self, keys: int, rate: float):
        if keys <= 0 or not 0 < rate < 1:
            raise ValueError("a Bloom filter needs expected keys and a rate between 0 and 1")
        self.bits = -(-int(-keys * math.log(rate) / math.log(2) ** 2) // 8) * 8
        self.hashes = max(1, min(30, int(self.bits / keys * math.log(2))))
        self.data = np.zeros(self.bits // 8, np.uint8)

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The bits of every key, one row a key."""
        first, second = (hash32_batch(keys, s).astype(np.uint64) for s in SEEDS)
        return ((first[:, None] + np.arange(self.hashes, dtype=np.uint64) * (second | np.uint64(1))[:, None]) % np.uint64(self.bits)).astype(np.int64)

    def add_all(self, keys: list[bytes]) -> None:
        at = self.places(keys).ravel()
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def add(self, key: bytes) -> None:
        self.add_all([key])

    def may_contain(self, key: bytes) -> bool:
        at = self.places([key])[0]
        return bool((self.data[at >> 3] >> (at & 7) & 1).all())

    @classmethod
    def of(cls, keys: list[bytes], rate: float = 0.01) -> BloomFilter:
        out = cls(len(keys), rate)
        out.add_all(keys)
        return out


def _places_of(shape: BloomFilter):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(data: pd.Series) -> pd.Series:
        at, values = _some(data)
        out = pd.Series([None] * len(data), dtype=object)
        for i, row in zip(at.tolist(), shape.places(values) if values else (), strict=True):
            out.iloc[i] = row
        return out

    return places


def bloom_words(keys, key: str, n: int, rate: float = 0.01):
    """(word, bits): the set 64-bit words of the exact filter of a column of keys; partial bit_or before the shuffle.

    n: the number of keys that the filter is sized for.
    """
    places = _places_of(BloomFilter(n, rate))
    each = keys.where(F.col(key).isNotNull()).select(F.explode(places(key)).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    return each.select(F.shiftright("at", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def bloom_probe(keys, key: str, words, n: int, rate: float = 0.01):
    """The rows of ``keys`` with ``may_contain``; probes and filter words meet in an equi-join on the word."""
    places = _places_of(BloomFilter(n, rate))
    probes = keys.select(key).distinct().select(key, F.explode(places(key)).alias("at"))
    probes = probes.select(key, F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = probes.join(words, "word", "left").groupBy(key).agg(F.min(F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))).alias("may_contain"))
    return keys.join(found, key)

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import hashing, hlc


def bitwise_crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc_has_the_known_check_value():
    assert hashing.crc32c(b"123456789") == 0xE3069283
    assert hashing.crc32c(b"") == 0


def test_crc_of_columns_equals_the_bitwise_definition(spark):
    rng = random.Random(2)
    values = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 3, 64, 511, 512, 513, 1500)]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)] + [(99, None)], "i int, v binary")
    rows = {r["i"]: r["c"] for r in df.select("i", hashing.crc32c_column(F.col("v")).alias("c")).collect()}
    assert [rows[i] for i in range(len(values))] == [bitwise_crc(v) for v in values]
    assert rows[99] is None


def test_crc_tells_a_flipped_bit():
    assert hashing.crc32c(b"hello") != hashing.crc32c(b"hellp")


def test_hash_depends_on_seed_and_every_byte(spark):
    words = [b"", b"a", b"ab", b"abc", b"abcd", b"abcde", b"abcdf"]
    assert len({hashing.hash32(w, s) for w in words for s in hashing.SEEDS}) == 2 * len(words)
    df = spark.createDataFrame([(bytearray(w),) for w in words], "w binary")
    got = {bytes(r["w"]): r["h"] for r in df.select("w", hashing.hash32_column(F.col("w"), F.lit(hashing.SEEDS[0])).alias("h")).collect()}
    assert got == {w: hashing.hash32(w, hashing.SEEDS[0]) for w in words}


def test_bloom_filter_has_no_false_negative_and_the_rate_asked_for():
    inside, outside = [b"in%d" % i for i in range(2000)], [b"out%d" % i for i in range(2000)]
    f = hashing.BloomFilter.of(inside, 0.01)
    assert all(map(f.may_contain, inside))
    assert sum(map(f.may_contain, outside)) < 60
    assert f.bits % 8 == 0


@pytest.mark.parametrize(("keys", "rate"), [(0, 0.01), (10, 0.0), (10, 1.0)])
def test_bloom_filter_refuses_bad_shapes(keys, rate):
    with pytest.raises(ValueError):
        hashing.BloomFilter(keys, rate)


def test_clock_is_strictly_increasing_when_time_stands_still_or_goes_back():
    times = iter([5, 5, 5, 3, 9])
    clock = hlc.Clock(now=lambda: next(times))
    got = [clock.next() for _ in range(5)]
    assert got == [5 << 16, (5 << 16) + 1, (5 << 16) + 2, (5 << 16) + 3, 9 << 16]


def test_clock_in_closed_form_equals_the_recurrence(spark):
    rng = random.Random(3)
    candidates = [rng.randrange(60) << 2 for _ in range(300)]
    last, want = 17, []
    for c in candidates:
        last = max(c, last + 1)
        want.append(last)
    df = spark.createDataFrame(list(enumerate(candidates)), "i int, c bigint")
    assert [r["t"] for r in df.select("i", hlc.timestamps(F.col("c"), F.col("i"), 17).alias("t")).orderBy("i").collect()] == want
    r = spark.range(1).select(hlc.pack(F.lit(1000), F.lit(7)).alias("p")).select("p", F.unix_millis(hlc.to_timestamp(F.col("p")))).first()
    assert tuple(r) == ((1000 << 16) + 7, 1000)


def test_hashes_of_batches_equal_single_ones():
    rng = random.Random(4)
    values = [bytes(rng.randrange(256) for _ in range(rng.randrange(14))) for _ in range(300)]
    for seed in (*hashing.SEEDS, 0):
        assert hashing.hash32_batch(values, seed).tolist() == [hashing.hash32(v, seed) for v in values]
    assert hashing.hash32_batch([], 1).tolist() == []

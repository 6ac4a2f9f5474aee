"""The ordered key codec and the other scalar codecs."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.functions import codec


def encode(parts):
    return b"".join(p.replace(b"\0", b"\0\xff") + b"\0\1" for p in parts)


def encoded(spark, triples):
    df = spark.createDataFrame([(i, *map(bytearray, t)) for i, t in enumerate(triples)], "i int, a binary, b binary, c binary")
    return [bytes(r["k"]) for r in df.select("i", codec.encode_key(F.col("a"), F.col("b"), F.col("c")).alias("k")).orderBy("i").collect()]


def decoded(spark, keys):
    df = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(keys)], "i int, k binary")
    rows = df.select("i", codec.decode_key(F.col("k")).alias("d"), codec.key_is_valid(F.col("k")).alias("ok")).orderBy("i").collect()
    assert all(r["ok"] == (r["d"] is not None) for r in rows)
    return [None if r["d"] is None else tuple(map(bytes, r["d"])) for r in rows]


#: Pairs of keys of which the first sorts before the second.
ORDERED = [
    ((b"ab", b"c", b"d"), (b"abc", b"c", b"d")),
    ((b"a\0c", b"x", b"y"), (b"a\1c", b"x", b"y")),
    ((b"aa", b"bb", b"c"), (b"ab", b"bb", b"c")),
    ((b"ab", b"b", b"d"), (b"ab", b"c", b"d")),
    ((b"ab", b"c", b"c"), (b"ab", b"c", b"d")),
    ((b"ab", b"zzz", b"zzz"), (b"abc", b"aaa", b"aaa")),
]


def test_order_of_pairs(spark):
    keys = encoded(spark, [t for pair in ORDERED for t in pair])
    assert all(keys[i] < keys[i + 1] for i in range(0, len(keys), 2))


def test_byte_order_is_component_order_on_random_triples(spark):
    rng = random.Random(1)
    triples = [tuple(bytes(rng.choice((0, 1, 2, 97, 255)) for _ in range(rng.randrange(4))) for _ in range(3)) for _ in range(400)]
    keys = encoded(spark, triples)
    assert keys == [encode(t) for t in triples]
    assert [t for _, t in sorted(zip(keys, triples, strict=True))] == sorted(triples)
    assert decoded(spark, keys) == triples


def test_round_trips_of_binary_and_empty_fields(spark):
    triples = [(bytes.fromhex("00FF0100"), bytes.fromhex("FF00FE"), bytes.fromhex("00000101")), (b"", b"a", b""), (b"", b"", b"")]
    assert decoded(spark, encoded(spark, triples)) == triples


def test_malformed_keys_are_null(spark):
    bad = ["616200", "610002000100010001", "61620001", "", "00", "6100FF"]
    assert decoded(spark, [bytes.fromhex(x) for x in bad]) == [None] * len(bad)


def test_bytes_after_the_third_field_are_ignored(spark):
    assert decoded(spark, [encode((b"a", b"b", b"c")) + b"\0rest"]) == [(b"a", b"b", b"c")]


@pytest.mark.parametrize(("size", "values"), [(1, [0, 255]), (2, [0, 65535]), (4, [0, 1, 2**32 - 1]), (8, [0, 2**63 - 1, 2**64 - 1])])
def test_integers_round_trip(spark, size, values):
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast("decimal(20,0)").alias("v"))
    rows = df.select("v", codec.encode_uint(F.col("v"), size).alias("b")).withColumn("back", codec.decode_uint(F.col("b"), 0, size)).collect()
    assert [(int(r["v"]).to_bytes(size, "big"), int(r["v"])) for r in rows] == [(bytes(r["b"]), int(r["back"])) for r in rows]


def test_integers_that_do_not_fit_or_are_out_of_range_are_null(spark):
    r = spark.range(1).select(codec.encode_uint(F.lit(256), 1).alias("a"), codec.encode_uint(F.lit(-1), 4).alias("b"), codec.decode_uint(F.unhex(F.lit("010203")), 0, 4).alias("c"), codec.decode_uint(F.unhex(F.lit("01020304")), 2, 2).alias("d")).first()
    assert tuple(r) == (None, None, None, 0x0304)


#: id and its file name.
NAMES = [(1, "sst_00000001.db"), (10, "sst_00000010.db"), (101, "sst_00000101.db"), (1010, "sst_00001010.db"), (10101, "sst_00010101.db"), (101010, "sst_00101010.db"), (123456789, "sst_123456789.db")]


def test_file_names(spark):
    df = spark.createDataFrame(NAMES, "i bigint, n string")
    rows = df.select("i", "n", codec.run_file_name(F.col("i")).alias("f"), codec.parse_run_file_name(F.concat(F.lit("/some/where/"), "n")).alias("p")).collect()
    assert all(r["f"] == r["n"] and r["p"] == r["i"] for r in rows)
    odd = spark.createDataFrame([("sst_x.db",), ("xsst_00000001.db",), ("sst_00000001.db.tmp",), ("sst_99999999999999999999.db",), ("wal_00000007.log",)], "n string")
    assert [tuple(r) for r in odd.select(codec.parse_run_file_name(F.col("n")), codec.parse_log_file_name(F.col("n"))).collect()] == [(0, None)] * 4 + [(0, 7)]


def test_trimming_and_sizes(spark):
    r = spark.range(1).select(codec.trim_blanks(F.lit(" \t\n a b \r\u000b\u000c")), codec.trim_blanks(F.lit("\n ")), codec.mib_to_bytes(F.lit(3)), codec.bytes_to_mib(F.lit(3_145_729))).first()
    assert tuple(r) == ("a b", "", 3_145_728, 3)

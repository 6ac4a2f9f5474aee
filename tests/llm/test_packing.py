import zlib

import numpy as np
import pytest
import public_tokenizers
from corpus_cases import ODD, documents
from tokenizers import Tokenizer

from cellweave.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, length):
    """Every document's ids lie in its pieces once and in order; sequences are gapless and full."""
    tokenizer, want = Tokenizer.from_file(PATH), {}
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault((i, len(ids)), []).append(ids)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(want)
    for key, parts in pieces.items():
        assert sum(p["length"] for p in parts) == key[1] * len(want[key])
        for p in parts:
            assert p["ids_crc32"] in {zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for ids in want[key]}
        starts = sorted((p["start"], p["length"]) for p in parts)
        assert [s for s in starts if s[0] == 0].__len__() == len(want[key])
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= length and (at == length or at & (at - 1) == 0)


@pytest.mark.parametrize(("length", "block"), [(2048, 2_000_000), (64, 500)])
def test_round_trip_of_odd_documents(spark, length, block):
    docs = [*ODD, (40, "don't  stop-now, it's 3.14\x1cx"), (41, "ÀÉÎ naïve Straße (UPPER) lower"), (42, "a" * 5000)]
    rows = op.pack_documents(documents(spark, docs, extra=("start", "length", "offset")), PATH, length=length, block_tokens=block).collect()
    check(rows, docs, length)


def test_round_trip_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(op.pack_documents(df, PATH).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], 2048)


def test_words_of_the_pipeline_take_little_memory_and_forgotten_words_keep_their_ids(monkeypatch):
    import tracemalloc

    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda docs, tokenizer, **given: op.Encoder(tokenizer, 1, **given))
    encode = corpus_pipeline.packing(None, None, "")
    letters = "abcdefghijklmnop"
    word = lambda i: "".join(letters[i >> 4 * k & 15] for k in range(5))
    texts = [" ".join(map(word, range(i, i + 20_000))) for i in range(0, 700_000, 20_000)]
    first = encode(texts[0])
    tracemalloc.start()
    for t in texts[1:]:
        encode(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6
    assert word(0) not in encode.young and word(0) not in encode.old
    assert encode(texts[0]).tolist() == first.tolist() == [*Tokenizer.from_file(PATH).encode(texts[0], add_special_tokens=False).ids, 1]


def test_empty_table(spark):
    assert op.pack_documents(documents(spark, []), PATH).count() == 0


def in_order(sizes, length=2048):
    """(costs of full sequences, cut documents) if documents are cut at each border in their order."""
    costs, cut, room, cost = [], 0, length, 0.0
    for n in sizes.tolist():
        cut += n > room
        while n:
            part = min(n, room)
            cost += part + part * part / length
            room, n = room - part, n - part
            if not room:
                costs.append(cost)
                room, cost = length, 0.0
    return costs, cut


def packed(sizes, length=2048):
    cost, used, parts = {}, {}, {}
    for d, _, n, s, _ in op.pack(sizes, length):
        cost[s] = cost.get(s, 0) + n + n * n / length
        used[s] = used.get(s, 0) + n
        parts[d] = parts.get(d, 0) + 1
    assert sum(used.values()) == sizes.sum() and max(used.values()) <= length
    return [cost[s] for s in cost if used[s] == length], sum(n > 1 for n in parts.values())


def test_costs_are_balanced_and_few_documents_are_cut():
    rng = np.random.default_rng(1)
    small, mixed = rng.integers(1, 400, 3000), rng.integers(1, 3000, 600)
    assert np.std(packed(small)[0]) < 0.5 * np.std(in_order(small)[0])
    assert packed(small)[1] < in_order(small)[1]
    assert packed(mixed)[1] < in_order(mixed)[1]


def test_long_documents_fill_whole_sequences():
    pieces = op.pack(np.array([5000, 10, 2048, 7]), 2048)
    assert sorted(p[2] for p in pieces if p[0] == 0)[-2:] == [2048, 2048] and [p[2] for p in pieces if p[0] == 2] == [2048]

import random

import pytest
from corpus_cases import LONG, ODD, blank_words, documents, low

from cellweave.llm import near_dup as op
from cellweave.llm.components import components


def brute(docs, width=4, percent=80):
    """(n_shingles, component, kept) of every row; rows of one doc_id are one document."""
    sets = []
    for i, t in docs:
        w = blank_words(low(t))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    group = {i: i for i, _ in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t) and find(i) != find(j):
                low_, high = sorted((find(i), find(j)))
                group[high] = low_
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def drifting(rng, chains, length, words=80):
    """Groups in which most texts are changed again and again: many are linked with neighbours only."""
    vocabulary, out = [f"w{i}" for i in range(200)], []
    for _ in range(chains):
        base = [rng.choice(vocabulary) for _ in range(words)]
        now = list(base)
        for _ in range(length):
            now = list(now) if rng.random() < 0.6 else list(base)
            for _ in range(rng.choice((1, 1, 2, 3))):
                now[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(now))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [16, 2048])
def test_equals_brute_force_on_drifting_copies(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    texts = drifting(random.Random(3), 2, 70)
    docs = [*enumerate(texts, 100), *((200 + 3 * k, texts[5]) for k in range(30))]
    assert rows_of(op.near_duplicates(documents(spark, docs))) == brute(docs)


def test_odd_documents(spark):
    docs = [*ODD, (50, LONG + " tail"), (51, "A  b\tC"), (52, "a b c"), (53, "a b"), (54, "À b c d"), (55, "à b c d"), (56, "é x b c d"), (57, "one")]
    got = rows_of(op.near_duplicates(documents(spark, docs, extra=("set_key", "id", "kept", "bands"))))
    assert got == brute(docs)
    assert op.near_duplicates(documents(spark, [])).count() == 0
    assert rows_of(op.near_duplicates(documents(spark, [(1, None), (2, "")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(op.near_duplicates(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1040)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert {k: got.get(k, k) for k in [*range(61), *range(1000, 1040)]} == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1040)}}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_a_text_of_exactly_one_shingle_has_the_hash_of_that_shingle():
    from cellweave.llm.shingles import shingle_set

    assert shingle_set("a a a a", 4).tolist() == shingle_set("a a a a a", 4).tolist()
    assert shingle_set("a b c d", 4)[0] in shingle_set("a b c d e", 4) and len(shingle_set("a b c", 4)) == 1


def test_ids_with_several_texts_lose_no_link(spark):
    """One id with two texts that have nothing in common: whatever signature is met first, both texts' links must be found."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(500)}"
    docs = []
    for k in range(12):
        a, b = [word() for _ in range(60)], [word() for _ in range(60)]
        docs += [(10 * k + 1, " ".join(a)), (10 * k + 1, " ".join(b)), (10 * k + 2, " ".join([*a, word()])), (10 * k + 3, " ".join([*b, word()]))]
    rng.shuffle(docs)
    assert rows_of(op.near_duplicates(documents(spark, docs))) == brute(docs)


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_layers_of_a_star_lose_no_link(spark, monkeypatch, percent):
    monkeypatch.setattr(op, "BLOCK", 7)
    docs = list(enumerate(drifting(random.Random(percent), 1, 110, 50)))
    assert rows_of(op.near_duplicates(documents(spark, docs), percent=percent)) == brute(docs, percent=percent)


def test_recall_on_a_larger_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows_of(op.near_duplicates(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])

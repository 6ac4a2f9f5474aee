import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_cases import LONG, ODD, blank_words, documents, low
from pyspark.sql import functions as F

from cellweave.llm import katz as op

START, END = object(), object()


class Model:
    """The backoff model, written down token by token."""

    def __init__(self, train):
        self.word, self.pair, self.history = Counter(), defaultdict(Counter), Counter()
        for tokens in train:
            last = START
            for t in tokens:
                self.word[t] += 1
                self.pair[last][t] += 1
                self.history[last] += 1
                last = t
        self.n, self.v = sum(self.word.values()), len(self.word)
        self.word_discount = self.good_turing(list(self.word.values()))
        self.pair_discount = self.good_turing([c for x in self.pair.values() for c in x.values()])
        self.factor, self.unknown = self.share(self.word.values(), self.word_discount) if self.n else (1.0, 1.0)

    @staticmethod
    def good_turing(counts):
        n = Counter(counts)
        d = {r: (r - 0.5) / r for r in range(1, 6)}
        if n[1] and 6 * n[6] / n[1] < 1:
            common = 6 * n[6] / n[1]
            for r in range(1, 6):
                if n[r] and 0 < (x := ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)) <= 1:
                    d[r] = x
        return d

    @staticmethod
    def share(counts, d):
        total = sum(counts)
        left = sum(c * (1 - d.get(c, 1.0)) for c in counts) / total
        return (1.0, left) if left > 1e-12 else (total / (total + 1), 1 / (total + 1))

    def p_word(self, w):
        c = self.word[w]
        return self.factor * c * self.word_discount.get(c, 1.0) / self.n if c else self.unknown

    def p(self, w, h):
        seen = self.pair.get(h)
        if not seen:
            return self.p_word(w)
        factor, left = self.share(seen.values(), self.pair_discount)
        if seen[w]:
            return factor * seen[w] * self.pair_discount.get(seen[w], 1.0) / self.history[h]
        return left / (1 - sum(self.p_word(x) for x in seen)) * self.p_word(w)


def tokens_of(text):
    return [*blank_words(low(text)), END]


def brute(rows):
    """rows: (doc_id, text, held out)."""
    m = Model([tokens_of(t) for _, t, h in rows if not h])
    out = []
    for i, t, h in rows:
        tokens, score, last = tokens_of(t), 0.0, START
        for w in tokens:
            score += math.log10(m.p(w, last))
            last = w
        base = sum(math.log10((m.word[w] + 1) / (m.n + m.v + 1)) for w in tokens)
        out.append((i, h, len(tokens), sum(m.word[w] > 0 for w in tokens), m.n, base, score))
    return m, sorted(out, key=str)


def same(got, want):
    key = lambda r: str(tuple(r)[:5]) + f"{r[5]:.6f}"
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-6) for a, b in zip(got, want, strict=True) for k in (5, 6))


def zipf(rng, n, words):
    vocabulary = [f"W{i}" for i in range(300)]
    return [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=rng.randrange(words))) for _ in range(n)]


@pytest.mark.parametrize(("block", "cell", "parts"), [(2_000_000, 1_000_000, 2000), (900, 200, 2)])
def test_scores_equal_the_token_by_token_model(spark, monkeypatch, block, cell, parts):
    monkeypatch.setattr(op, "CELL_KEYS", cell)
    rng = random.Random(1)
    texts = [*zipf(rng, 150, 120), *(t for _, t in ODD), "unseen words only", "W1 W2 W1 W2"]
    rows = [(i if t is not None else None, t, i % 7 == 2) for i, t in enumerate(texts)]
    docs = documents(spark, [(i, t) for i, t, _ in rows], extra=("block", "score", "held"))
    held = {t for _, t, h in rows if h}
    rows = [(i, t, t in held) for i, t, _ in rows]
    flag = F.coalesce(F.col("text").isin([t for t in held if t is not None]), F.lit(None in held))
    model, want = brute(rows)
    if parts == 2:
        monkeypatch.setattr(op, "HOT_PARTS", max(1, model.n // 1000))
    same(op.katz_scores(docs, flag, block_tokens=block).collect(), want)


def test_probabilities_after_any_history_sum_to_one():
    model, _ = brute([(i, t, False) for i, t in enumerate(zipf(random.Random(2), 100, 60))])
    for h in [START, *list(model.word)[:40], "never seen"]:
        assert math.isclose(sum(model.p(w, h) for w in model.word) + model.p("unknown", h), 1.0, rel_tol=1e-9)


def test_pairs_predict_better_than_words(spark):
    rng = random.Random(3)
    follow = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(3)] for i in range(60)}
    texts = []
    for _ in range(300):
        now, text = "w0", []
        for _ in range(40):
            now = rng.choice(follow[now])
            text.append(now)
        texts.append(" ".join(text))
    rows = op.katz_scores(documents(spark, list(enumerate(texts))), F.col("doc_id") % 7 == 2).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.5 * sum(r["base_score"] for r in rows)


def test_held_out_copies_of_training_texts_score_above_new_texts(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randrange(60, 200)))
    train = [text() for _ in range(200)]
    held = [(1000 + i, train[i]) for i in range(40)] + [(2000 + i, text()) for i in range(40)]
    rows = op.katz_scores(documents(spark, list(enumerate(train)) + held), F.col("doc_id") >= 1000).where("held_out").collect()
    each = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows}
    assert min(each[1000 + i] for i in range(40)) > max(each[2000 + i] for i in range(40))


def test_pairs_of_a_block_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    n, words, docs = 400_000, 60_000, 800
    hashes = rng.integers(0, 1 << 63, words, dtype=np.uint64)
    tokens = (words * rng.random(n) ** 4).astype(np.uint32)
    block = {"tokens": op._zip(tokens), "sizes": [n // docs] * docs, "held": [False] * docs, "words": hashes.tobytes(), "starts": docs}
    count = np.bincount(tokens, minlength=words)
    cells = [(0, op._zip(count[np.argsort(hashes)]))]
    tracemalloc.start()
    x = op.Pairs(block, cells, 4, 1000)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert x.history_count[x.h[0]] > 0 and len(x.back) == n
    history = np.where(np.arange(n) % (n // docs) == 0, words, np.roll(tokens, 1))
    at = np.empty(len(x.order), np.int64)
    at[x.order] = np.arange(len(x.order))
    assert (x.h[at[x.back]] == history).all() and (x.w[at[x.back]] == tokens).all()
    assert kept < 30 * n and peak < 65 * n, (kept / n, peak / n)


def test_no_training_rows_and_no_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    rows = op.katz_scores(docs, F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert op.katz_scores(docs.limit(0), F.lit(False)).count() == 0
    same(op.katz_scores(documents(spark, [(1, LONG)]), F.lit(False)).collect(), brute([(1, LONG, False)])[1])


def test_query(spark, sf_dir):
    from zlib import crc32

    from cellweave.llm.queries import op9_katz

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    same(op9_katz(spark, sf_dir).collect(), brute([(r["doc_id"], r["text"], crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in docs])[1])

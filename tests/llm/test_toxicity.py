import math
import random
import re

import pytest
from corpus_cases import LONG, ODD, documents

from cellweave.llm import toxicity as op


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_levenshtein_distances():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    terms = {word(rng.randrange(3, 11)): rng.random() for _ in range(60)}
    automaton = op.LexiconAutomaton(terms, {})
    for _ in range(3000):
        w = list(rng.choice(list(terms))) if rng.random() < 0.7 else list(word(rng.randrange(1, 11)))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = word(rng.randrange(2))
        w = "".join(w)
        near = [distance(w, t) for t in terms if distance(w, t) <= op.edits_for(t)]
        got = automaton.match(w)
        assert (got and got[1]) == (min(near) if near else None), w


def test_context_tells_quotation_from_abuse():
    automaton = op.LexiconAutomaton({"blorgh": 2.0}, {})
    score = lambda t: op.features(t, automaton, {})
    exact, fuzzy, quoted = 0, 1, 2
    assert score("you blorgh go away")[exact] > 0 and score("you blorgh go away")[quoted] == 0
    assert score("she said the word “blorgh” was used")[quoted] > 0 and score("she said the word “blorgh” was used")[exact] == 0
    assert score("you are a blorrgh today")[fuzzy] > 0
    assert score("nothing here") == score(None) == score("") == [0.0] * 6


def test_learned_terms_separate_held_out_documents(spark):
    from cellweave.llm.queries import op3_toxicity

    d = "/root/testdata/sf0.1"
    rows = op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert len(bad) >= 5 and len(good) >= 50
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert above >= 0.95 and right >= 0.95, (above, right)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.02 * len(good)


LABELS = "doc_id bigint, toxic int, quality int, score string"


def made(rng, n):
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(("grumblix", "snarfing", "plorkers"))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0), 1, "x"))
    return rows, labels


def test_odd_rows_and_determinism(spark):
    rows, labels = made(random.Random(2), 200)
    odd = [(1000 + k, t) for k, (_, t) in enumerate(ODD)]
    docs = documents(spark, [*rows, *odd, (2000, LONG + " grumblix"), (2001, "GRUMBLIX grumblixx"), (None, "grumblix you"), (None, None)], extra=("toxic", "score", "y"))
    table = spark.createDataFrame([*labels, (None, 1, 1, "x"), (5, None, 1, "x"), (7, 0, 0, "again")], LABELS)
    first, second = op.toxicity(docs, table).collect(), op.toxicity(docs.repartition(3), table).collect()
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, second), key=str)
    assert len(first) == 200 + len(odd) + 4 and all(0 <= r["score"] <= 1 for r in first)
    by = {r["doc_id"]: r for r in first}
    assert by[2001]["score"] > 0.5 > by[1000]["score"] and by[1000]["score"] == by[1001]["score"] and by[2000]["hits"] == 1
    assert all((by[i]["score"] >= 0.5) == bool(y) for i, y, _, _ in labels)


@pytest.mark.parametrize("labels", [[], [(0, 1, 1, "x")], [(0, 0, 1, "x"), (1, 0, 1, "x")], [(None, 1, 1, "x")]])
def test_without_usable_labels_all_scores_are_low(spark, labels):
    rows, _ = made(random.Random(2), 8)
    got = op.toxicity(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 8 and all(r["score"] < 0.5 for r in got)
    assert op.toxicity(documents(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_terms_of_any_length(spark):
    rng = random.Random(8)
    rows, labels = made(rng, 120)
    long = "z" * 5000 + "q"
    docs = [(i, t + (f" {long} zat" if y else "")) for (i, t), (_, y, _, _) in zip(rows, labels, strict=True)]
    docs = [*docs, (500, f"some words with {long[1:]} here"), (501, "some words with zat here"), (502, "some words with zet here")]
    words, stems, _ = op.fit(documents(spark, docs).select("doc_id", "text"), spark.createDataFrame(labels, LABELS), 1000)
    assert "zat" in words and (long in words or any(long.startswith(s) for s in stems))
    by = {r["doc_id"]: r["hits"] for r in op.toxicity(documents(spark, docs), spark.createDataFrame(labels, LABELS)).collect()}
    assert by[500] == 1 and by[501] == 1 and by[502] == 0


def test_no_term_is_left_out(spark):
    docs = [(i, " ".join(f"bad{k}x" for k in range(6000))) for i in range(4)] + [(10 + i, "good words only") for i in range(4)]
    labels = [(i, int(i < 4), 1, "x") for i, _ in docs]
    words, stems, _ = op.fit(documents(spark, docs).select("doc_id", "text"), spark.createDataFrame(labels, LABELS), 1000)
    assert all(f"bad{k}x" in words or any(f"bad{k}x".startswith(s) for s in stems) for k in range(6000))


def brute_score(text, words, stems, weights):
    """The score of a text, by distances to every term."""
    low = (text or "").lower()
    found = list(re.finditer(r"[^\W_]+", low))
    tokens = [m[0] for m in found]
    hits = {}
    for i, w in enumerate(tokens):
        if w in words:
            hits[i] = (words[w], 0)
        elif short := [stems[w[:n]] for n in range(4, 9) if len(w) >= n and w[:n] in stems]:
            hits[i] = (short[0], 0)
        else:
            near = [(d, -words[t], t) for t in words if abs(len(t) - len(w)) <= 2 and (d := distance(w, t)) <= (0 if len(t) < 5 else 1 if len(t) < 9 else 2)]
            if near:
                hits[i] = (-min(near)[1], min(near)[0])
    kinds = {}
    marks = '"“”«»„'
    for i, (weight, edits) in hits.items():
        around = tokens[max(0, i - 6) : i] + tokens[i + 1 : i + 7]
        left = low[found[max(0, i - 6)].start() : found[i].start()]
        right = low[found[i].end() : found[min(len(tokens) - 1, i + 6)].end()]
        quote = sum(w in op.REPORTING for w in around) + 2 * (any(c in left for c in marks) and any(c in right for c in marks))
        abuse = sum(w in op.ADDRESS for w in around) / 2 + sum(j != i and abs(j - i) <= 6 for j in hits)
        kinds.setdefault(tokens[i], []).append(("quoted" if quote > abuse else "fuzzy" if edits else "exact", weight / (edits + 1)))
    best = [min(x) for x in kinds.values()]
    x = [math.log1p(sum(w for k, w in best if k == kind)) for kind in ("exact", "fuzzy", "quoted")] + [math.log1p(len(best)), math.log1p(len(hits)), 100 * len(best) / (len(tokens) + 20) if hits else 0.0]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, weights, strict=False)) + weights[-1]))))


def test_scores_equal_brute_force(spark):
    rng = random.Random(9)
    rows, labels = made(rng, 160)
    forms = ["grumblix", "grumblx", "snarfingly", "snrafing", "plorkers", "plorker", "“plorkers”", "you", "said", "term", "word5", '"', "GRUMBLIXX", "zz"]
    docs = [*rows, *((1000 + i, " ".join(rng.choice(forms) for _ in range(rng.randrange(25)))) for i in range(150)), (2000, None), (2001, "")]
    table = spark.createDataFrame(labels, LABELS)
    words, stems, weights = op.fit(documents(spark, docs).select("doc_id", "text"), table, 10_000)
    texts = dict(docs)
    got = op.toxicity(documents(spark, docs), table).collect()
    assert len(got) == len(docs) and all(math.isclose(r["score"], brute_score(texts[r["doc_id"]], words, stems, weights), rel_tol=1e-9) for r in got)

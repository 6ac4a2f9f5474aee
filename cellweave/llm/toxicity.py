"""Toxicity scores from a learned lexicon, matched by Levenshtein automata over a trie, with context windows.

The lexicon is learned from labelled rows: whole words, and stems (word beginnings) for languages whose terms are inflected,
that stand in many toxic and few clean documents. Its terms form a trie; intersected with Levenshtein automata it accepts a term
within an edit distance that grows with the term's length. The intersection is determinised lazily, so a word costs one table
look-up a letter, and most words leave the automaton after two or three letters.

Every hit is scored in its window of neighbouring words: quotation marks and words of reporting around it count it as quotation,
other hits beside it and words of address count it as abuse. A logistic regression over a few such sums per document gives the
score. Labels, language, source and doc_id are never inputs of it.

The lexicon and the regression are fitted on at most ``sample`` labelled doc_ids (those with the least hashes), each with one text:
of several, the least in binary order. Counts are added up on the executors; the driver gets the terms that pass, none left out,
which are fewer than a quarter of the words of the sampled toxic texts, and one row of features a sampled text. Scoring is local
to a row: no shuffle, constant memory.

Defined results: null and empty texts have no hits and get the score of a text without hits; repeated rows are scored alike;
without a usable labelled row the score is 0 for all; labels that are null, or whose doc_id is, are ignored; words and terms may
have any length, of which those under five letters match exactly only; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

WORDS = re.compile(r"[^\W_]+")
QUOTES = re.compile("[\"“”«»„]")
REPORTING = frozenset("said says wrote quote quoted quotes called calls calling word words term terms insult insults dit dijo sagte".split())
ADDRESS = frozenset("you your youre u are ur tu du sie vous usted eres bist es".split())
WINDOW = 6
STEM_LENGTHS = (4, 5, 6, 7, 8)


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The lazily determinised intersection of a trie of terms with Levenshtein automata, and of a trie of exact stems."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for w in sorted(words):
            at = 0
            for c in w:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                at = nxt
            self.ends[at] = w
        self.budget = [0] * len(self.children)  # most edits of any term below a node

        for at in range(len(self.children) - 1, -1, -1):  # children come after their parents
            self.budget[at] = max([edits_for(self.ends[at]) if self.ends[at] else 0, *(self.budget[c] for c in self.children[at].values())])
        self.start = self._close({0: 0})
        self.table: dict[tuple[frozenset, str], frozenset] = {}

    def _close(self, state: dict[int, int]) -> frozenset:
        """Adds the nodes reached by leaving letters of a term out; keeps the least edits of each node within its budget."""
        todo = list(state.items())
        while todo:
            node, e = todo.pop()
            if state.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.budget[child] and e + 1 < state.get(child, 99):
                    state[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset((n, e) for n, e in state.items() if e <= self.budget[n])

    def _step(self, state: frozenset, letter: str) -> frozenset:
        out: dict[int, int] = {}
        for node, e in state:
            if e + 1 < out.get(node, 99):
                out[node] = e + 1  # a letter too many
            for c, child in self.children[node].items():
                cost = e + (c != letter)
                if cost < out.get(child, 99):
                    out[child] = cost  # the letter, or another in its place
        return self._close({n: e for n, e in out.items() if e <= self.budget[n]})

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term, stems before misspelled words; None without one."""
        if (w := self.words.get(word)) is not None:
            return w, 0
        for n in STEM_LENGTHS:
            if len(word) >= n and (w := self.stems.get(word[:n])) is not None:
                return w, 0
        state, table = self.start, self.table
        for c in word:
            nxt = table.get((state, c))
            if nxt is None:
                if len(table) > 200_000:
                    table.clear()
                nxt = table[(state, c)] = self._step(state, c)
            if not nxt:
                return None
            state = nxt
        found = [(e, -self.words[t], t) for n, e in state if (t := self.ends[n]) is not None and e <= edits_for(t)]
        if not found:
            return None
        e, weight, _ = min(found)
        return -weight, e


def features(text: str | None, automaton: LexiconAutomaton, seen: dict[str, tuple[float, int] | None]) -> list[float]:
    """Sums over the hits of a text: abuse, misspelled abuse, quotation; the different terms, and the hits for their number of words."""
    text = text or ""
    low = text.lower()
    words = WORDS.findall(low)
    hits = []
    for i, w in enumerate(words):
        try:
            m = seen[w]
        except KeyError:
            if len(seen) > 300_000:
                seen.clear()
            m = seen[w] = automaton.match(w)
        if m is not None:
            hits.append((i, m))
    if not hits:
        return [0.0] * 6
    spans = None
    if QUOTES.search(text):
        spans = [(m.start(), m.end()) for m in WORDS.finditer(low)]
    best: dict[str, tuple[str, float]] = {}
    places = [i for i, _ in hits]
    for i, (weight, edits) in hits:
        window = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        report = sum(w in REPORTING for w in window)
        marks = 0
        if spans:
            left, right = low[spans[max(0, i - WINDOW)][0] : spans[i][0]], low[spans[i][1] : spans[min(len(words) - 1, i + WINDOW)][1]]
            marks = 2 * bool(QUOTES.search(left) and QUOTES.search(right))
        abuse = sum(w in ADDRESS for w in window) / 2 + bisect_right(places, i + WINDOW) - bisect_left(places, i - WINDOW) - 1
        where = "quoted" if report + marks > abuse else "fuzzy" if edits else "exact"
        best[words[i]] = min(best.get(words[i], ("z", 0.0)), (where, weight / (edits + 1)))  # a word counts once, as abuse if it ever is
    exact, fuzzy, quoted = (sum(w for k, w in best.values() if k == kind) for kind in ("exact", "fuzzy", "quoted"))
    kinds = len(best)
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(kinds), math.log1p(len(hits)), 100 * kinds / (len(words) + 20)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Fewest toxic documents of a term, and the least share of toxic ones among all that have it (and one more).
LEAST, PRECISION = 4, 0.75


def choose_terms(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights, from (term, is a stem, toxic documents, clean documents)."""

    def precision(a: int, b: int) -> float:
        return a / (a + b + 1)

    kept = sorted((x for x in counts if x[2] >= LEAST and precision(*x[2:]) >= PRECISION), key=lambda x: (-x[2], x[3], x[0], x[1]))
    weight = lambda a, b: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    whole = {t: (a, b) for t, s, a, b in kept if not s}
    told: dict[str, int] = {}  # by stem, the documents of its most frequent word
    for t, (a, _) in whole.items():
        for n in STEM_LENGTHS:
            told[t[:n]] = max(told.get(t[:n], 0), a)
    stems = {t: (a, b) for t, s, a, b in kept if s and 3 * told.get(t, 0) < 2 * a}
    slim = {t: ab for t, ab in stems.items() if not any(t[:n] in stems and precision(*stems[t[:n]]) >= precision(*ab) - 0.05 for n in STEM_LENGTHS if n < len(t))}
    words = {t: weight(*ab) for t, ab in whole.items() if not any(t[:n] in slim for n in STEM_LENGTHS if n < len(t))}
    return words, {t: weight(*ab) for t, ab in slim.items() if t not in words}


def document_terms(text: str | None) -> set[tuple[str, bool]]:
    words = set(WORDS.findall((text or "").lower()))
    return {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEM_LENGTHS if len(w) > n}


def fit(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[dict[str, float], dict[str, float], list[float]] | None:
    """Words, stems and regression weights, from documents (doc_id, text) and labels (doc_id, toxic)."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("y"))
    train = stored(docs.join(small(chosen, sample), F.col("doc_id") == F.col("k")).groupBy("k", "y").agg(F.min("text").alias("text")).select("y", "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of either label by term; terms of toxic documents only, as others can't be chosen."""
        for batch in batches:
            a, b = Counter(), Counter()
            n = [0, 0]
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                (a if y else b).update(document_terms(x.as_py()))
                n[bool(y)] += 1
            keys = [k for k in a] + [k for k in b if k not in a]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in keys] + [""]), pa.array([s for _, s in keys] + [False]), pa.array([a[k] for k in keys] + [n[1]], pa.int64()), pa.array([b[k] for k in keys] + [n[0]], pa.int64())], names=["term", "stem", "a", "b"])

    summed = train.mapInArrow(count, "term string, stem boolean, a bigint, b bigint").groupBy("term", "stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = summed.where(f"term = '' or (a >= {LEAST} and a >= {PRECISION} * (a + b + 1))").collect()
    total = next((r for r in rows if not r["term"]), None)
    if total is None or not total["a"] or not total["b"]:
        return None
    words, stems = choose_terms([(r["term"], r["stem"], r["a"], r["b"]) for r in rows if r["term"]], total["a"], total["b"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = LexiconAutomaton(words, stems), {}
        for batch in batches:
            x = [features(t.as_py(), automaton, seen) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    measured = train.mapInArrow(measure, "y int, x array<double>").groupBy("y", "x").count().collect()
    x = np.array([r["x"] for r in measured])
    repeats = np.array([r["count"] for r in measured])
    y = np.array([float(r["y"]) for r in measured])
    return words, stems, logistic(np.repeat(x, repeats, axis=0), np.repeat(y, repeats)).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 10_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, score, hits) of every document row; sample: most labelled rows that the model is fitted on."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = fit(own, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic")), sample)
    kind = own.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, w = model or ({}, {}, [0.0] * 6 + [-30.0])
        automaton, seen = LexiconAutomaton(words, stems), {}
        weights = np.array(w)
        for batch in batches:
            x = np.array([features(t.as_py(), automaton, seen) for t in batch.column(1)]).reshape(-1, 6)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(np.rint(np.expm1(x[:, 4])).astype(np.int64))], names=["doc_id", "score", "hits"])

    return own.mapInArrow(score, f"doc_id {kind}, score double, hits bigint")

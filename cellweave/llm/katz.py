"""Katz backoff language model (words and word pairs) over partitioned tables.

Good-Turing discounts apply to counts up to 5. The probability of a token is evaluated recursively: the discounted relative
frequency of its pair if the pair was seen, else the backoff weight of its history times the discounted frequency of the word,
else, for unknown words, the mass that the word level has left. Backoff weights are normalised exactly: over all known words and
the unknown one, the probabilities after any history sum to one.

Rows of single tokens would be far larger than the corpus, so all exchange is by *cells*: the corpus is cut into blocks of a
bounded number of tokens, and each block sends to each partition of a model table one compressed row with its distinct keys
there, and gets one row back with the counts of these keys in their order.

1. blocks: tokens as numbers of the block's own dictionary, written once to a bucketed table in the warehouse, so that later
   joins by block move what comes back from the model, never the tokens.
2. words: partitions by the word's hash add up training counts; counts of counts give N, V and the discounts.
3. pairs: partitions by the history's hash add up pair counts, and for each history the number of pairs with each small count
   and the word-level mass of its seen words. A history with more than 1/2000 of all tokens is dealt over several partitions by
   the second word, and its parts (at most 2000 histories) are put together on the driver.
4. scores: every block evaluates its tokens.

Words are known by 64-bit hashes (48 bits for the second word of a pair, within its history).

Defined results: a null text is scored as an empty one, which has its end token only; rows are scored one by one, so repeated
rows are repeated in the result and in the counts; a null doc_id is carried; other columns are not read; without any training
token all scores are those of a uniform unknown word; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, stored_at

SMALL = 5
HOT_PARTS = 2000
CELL_KEYS = 1_000_000
SLICE = 1 << 18
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n</s>", b"\n<s>"))


# Compressed arrays


def _zip(a: np.ndarray) -> bytes:
    """Byte planes, so that the bytes of small numbers compress to nothing."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) if len(a) else b""


def _unzip(b: bytes, kind: type) -> np.ndarray:
    if not b:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def _zip_sorted(a: np.ndarray) -> bytes:
    return _zip(np.diff(a, prepend=np.uint64(0)))


def _unzip_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, np.uint64), dtype=np.uint64)


def _cut(part: np.ndarray) -> dict[int, slice]:
    """The slices of a sorted array of part numbers, of the parts that occur: work goes with the keys, not with the number of parts."""
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return {p: slice(i, j) for p, i, j in zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=True)}


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition by the upper half of a hash: contiguous slices of sorted hashes."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


# The model's numbers


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discounts of counts 1 to 5 from the counts of counts 1 to 6; absolute ones where those are not proper."""
    out = np.array([(r - 0.5) / r for r in range(1, SMALL + 1)])
    if n[0] and (most := (SMALL + 1) * n[SMALL] / n[0]) < 1:
        for r in range(1, SMALL + 1):
            if n[r - 1]:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - most) / (1 - most)
                if 0 < d <= 1:
                    out[r - 1] = d
    return out


class Level:
    """Discounted frequencies with what they leave: total tokens, and the number of keys of each count up to 5."""

    def __init__(self, n: list[int]):
        self.d = np.concatenate([[0.0], discounts(n), [1.0]])

    def kept(self, total: np.ndarray, by_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(factor of the discounted frequencies, mass left) for histories; some mass is always left."""
        r = np.arange(1, SMALL + 1)
        lost = (by_count * (r * (1 - self.d[1:-1]))).sum(axis=-1)
        total = np.maximum(total, 1).astype(float)
        left = lost / total
        whole = left <= 1e-12
        return np.where(whole, total / (total + 1), 1.0), np.where(whole, 1 / (total + 1), left)

    def mass(self, count: np.ndarray) -> np.ndarray:
        return count * self.d[np.minimum(count, SMALL + 1)]


class Words:
    """The word level: N and V, probabilities of counts, and of an unknown word."""

    def __init__(self, total: int, kinds: int, n: list[int]):
        self.total, self.kinds, self.level = total, kinds, Level(n)
        factor, left = self.level.kept(np.array(total), np.array(n[:SMALL]))
        self.factor, self.unknown = float(factor), float(left) if total else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.factor * self.level.mass(count) / max(self.total, 1), self.unknown)


# 1. Blocks

BLOCK_SQL = "block bigint, docs array<bigint>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary, n_words int, train_tokens bigint, train_docs bigint"
BLOCK = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int32()), ("train_tokens", pa.int64()), ("train_docs", pa.int64())])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1  # 0 is the end token
        return n


def _blocks(block_tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers, docs, held, texts, size = _Numbers(), [], [], [], 0

        def done() -> pa.RecordBatch:
            sizes = np.array([len(t) for t in texts], np.int32)
            tokens = np.concatenate(texts)
            words = np.concatenate([[END], np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))]).astype(np.uint64)
            train = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(tokens[train], minlength=len(words)).astype(np.uint32)
            row = [block, docs, held, sizes.tolist(), _zip(tokens), words.tobytes(), _zip(counts), len(words), int(train.sum()), len(held) - sum(held)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

        for batch in batches:
            for d, h, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (x.as_py() or "").encode().lower().split()
                t = np.zeros(len(words) + 1, np.uint32)
                t[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                docs.append(d)
                held.append(bool(h))
                texts.append(t)
                size += len(t)
                if size >= block_tokens:
                    yield done()
                    block += 1
                    numbers, docs, held, texts, size = _Numbers(), [], [], [], 0
        if texts:
            yield done()

    return work


# 2. Words

CELL_SQL = "block bigint, part int, kind int, a binary, b binary, numbers array<bigint>"
CELL = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("numbers", pa.list_(pa.int64()))])
ASK_SQL = "block bigint, part int, hs binary, hot binary, ns binary, ws binary, cs binary, ks binary"
ASK = pa.schema([("block", pa.int64()), ("part", pa.int32()), *((x, pa.binary()) for x in ("hs", "hot", "ns", "ws", "cs", "ks"))])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _ask_words(parts: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = np.frombuffer(batch.column(1)[i].as_py(), np.uint64), _unzip(batch.column(2)[i].as_py(), np.uint32)
                order = np.argsort(words)
                words, counts = words[order], counts[order]
                rows = [(batch.column(0)[i].as_py(), p, 0, _zip_sorted(words[at]), _zip(counts[at]), None) for p, at in _cut(_part(words, parts)).items()]
                yield from _table(rows, CELL).to_batches()

    return work


def _count_words(cells: pa.Table) -> pa.Table:
    blocks, part = cells["block"].to_pylist(), cells["part"][0].as_py()
    words = [_unzip_sorted(x.as_py()) for x in cells["a"]]
    counts = [_unzip(x.as_py(), np.uint32) for x in cells["b"]]
    _, back = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
    seen = total[total > 0]
    numbers = [int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, SMALL + 2), minlength=SMALL + 3)[1 : SMALL + 2].tolist()]
    answer, at, rows = total[back], 0, []
    for block, w in zip(blocks, words, strict=True):
        rows.append((block, part, 0, _zip(answer[at : at + len(w)]), None, None))
        at += len(w)
    return _table([*rows, (None, part, 1, None, None, numbers)], CELL)


# 3. Pairs


class Pairs:
    """The distinct (history, word) pairs of a block in the order in which the pair partitions see them.

    A worker's memory is largest here, so places are 32-bit numbers (a text is below 2 GB, and a block ends with the text that
    fills it), and arrays go as soon as nothing needs them.
    """

    def __init__(self, block: dict, word_cells: list[tuple[int, bytes]], parts: int, hot: int):
        words = np.frombuffer(block["words"], np.uint64)
        self.tokens, self.sizes = _unzip(block["tokens"], np.uint32).view(np.int32), np.array(block["sizes"], np.int64)
        self.held = np.array(block["held"], bool)
        self.count = np.empty(len(words), np.int64)
        self.count[np.argsort(words)] = np.concatenate([_unzip(b, np.int64) for _, b in sorted(word_cells)])
        self.hashes = np.concatenate([words, [START]])
        self.n = n = len(words)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        key = np.empty(len(self.tokens), np.int64)
        key[1:] = self.tokens[:-1]
        key[self.first] = n
        key *= n
        key += self.tokens
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.back = np.empty(len(key), np.int32)
        self.back[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order
        key = key[new]
        h, w = (key // n).astype(np.int32), (key % n).astype(np.int32)
        del key, new
        self.history_count = np.concatenate([self.count, [block["starts"]]])
        dealt = np.maximum(1, -(-self.history_count // hot)).astype(np.uint64)
        hh, wh = self.hashes[h], self.hashes[w]
        mixed = wh % dealt[h]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hh
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        part = _part(mixed, parts).astype(np.int32)
        del mixed
        order = np.lexsort((wh, hh, part))
        del hh, wh
        self.order, self.h, self.w = order.astype(np.int32), h[order], w[order]
        self.hot = (dealt > 1)[self.h]
        self.at = _cut(part[order])

    def cell(self, p: int) -> tuple[slice, np.ndarray]:
        """The pairs of a partition, and where their histories begin."""
        s = self.at[p]
        h = self.h[s]
        return s, np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


def _block_of(left: pa.Table, starts: int) -> dict:
    return left.drop_columns(["words"]).to_pylist()[0] | {"words": left["words"][0].as_py(), "starts": starts}


def _ask_pairs(parts: int, hot: int, starts: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], ASK)
        x = Pairs(_block_of(left, starts), list(zip(right["part"].to_pylist(), right["a"].to_pylist(), strict=True)), parts, hot)
        train = np.repeat(~x.held, x.sizes)
        times = np.bincount(x.back[train], minlength=len(x.order)).astype(np.uint32)[x.order]
        rows = []
        for p in x.at:
            s, begins = x.cell(p)
            h, w = x.h[s], x.w[s]
            second = (x.hashes[w] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            rows.append((left["block"][0].as_py(), p, _zip_sorted(x.hashes[h[begins]]), _zip(x.hot[s][begins].astype(np.uint8)), _zip(np.diff(np.append(begins, len(h))).astype(np.uint32)), second, _zip(x.count[w].astype(np.uint32)), _zip(times[s])))
        return _table(rows, ASK)

    return work


def _count_pairs(words: Words):
    def work(cells: pa.Table) -> pa.Table:
        part, blocks = cells["part"][0].as_py(), cells["block"].to_pylist()
        hs = [_unzip_sorted(x.as_py()) for x in cells["hs"]]
        ns = [_unzip(x.as_py(), np.uint32) for x in cells["ns"]]
        hot = np.concatenate([_unzip(x.as_py(), np.uint8) for x in cells["hot"]]).astype(bool)
        second = np.zeros((sum(int(n.sum()) for n in ns), 8), np.uint8)
        second[:, :6] = np.frombuffer(b"".join(x.as_py() for x in cells["ws"]), np.uint8).reshape(-1, 6)
        w = second.view(np.uint64).ravel()
        count = np.concatenate([_unzip(x.as_py(), np.uint32) for x in cells["cs"]])
        times = np.concatenate([_unzip(x.as_py(), np.uint32) for x in cells["ks"]])
        kinds, each = np.unique(np.concatenate(hs), return_inverse=True)
        h = np.repeat(each, np.concatenate(ns))
        order = np.lexsort((w, h))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=times).astype(np.int64)
        one = order[new]
        seen = total > 0
        by_count = np.zeros((len(kinds), SMALL), np.int64)
        few = seen & (total <= SMALL)
        np.add.at(by_count, (h[one][few], total[few] - 1), 1)
        mass = np.bincount(h[one][seen], weights=words.p(count[one][seen].astype(np.int64)), minlength=len(kinds))
        numbers = np.bincount(np.minimum(total[seen], SMALL + 2), minlength=SMALL + 3)[1 : SMALL + 2].tolist()
        rows, at, ah = [(None, part, 3, None, None, numbers)], 0, 0
        for block, own, n in zip(blocks, hs, ns, strict=True):
            k = each[ah : ah + len(own)]
            size = int(n.sum())
            rows.append((block, part, 2, _zip(total[group[at : at + size]].astype(np.uint32)), b"".join([_part_bytes(by_count[k]), mass[k].tobytes()]), None))
            at, ah = at + size, ah + len(own)
        whole = np.zeros(len(kinds), bool)
        whole[each[hot]] = True
        for k in np.flatnonzero(whole).tolist():
            rows.append((None, part, 4, kinds[k].tobytes(), mass[k].tobytes(), by_count[k].tolist()))
        return _table(rows, CELL)

    return work


def _part_bytes(by_count: np.ndarray) -> bytes:
    packed = _zip(by_count.astype(np.uint32).ravel())
    return len(packed).to_bytes(8, "little") + packed


def _split_bytes(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(b[:8], "little")
    return _unzip(b[8 : 8 + n], np.uint32).reshape(-1, SMALL).astype(np.int64), np.frombuffer(b[8 + n :], np.float64)


# 4. Scores

SCORE_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(words: Words, pairs: Level, hot_rows: dict[int, tuple[list[int], float]], parts: int, hot: int, starts: int):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORE.empty_table()
        kinds = right["kind"].to_pylist()
        cells = list(zip(right["part"].to_pylist(), right["a"].to_pylist(), right["b"].to_pylist(), strict=True))
        block = _block_of(left, starts)
        x = Pairs(block, [(p, a) for k, (p, a, _) in zip(kinds, cells, strict=True) if k == 0], parts, hot)
        by_count, mass = np.zeros((x.n + 1, SMALL), np.int64), np.zeros(x.n + 1)
        total = np.zeros(len(x.order), np.uint32)
        for k, (p, a, b) in zip(kinds, cells, strict=True):
            if k != 2:
                continue
            s, begins = x.cell(p)
            total[s] = _unzip(a, np.uint32)
            own = x.h[s][begins]
            by_count[own], mass[own] = _split_bytes(b)
        if hot_rows:
            for h in np.unique(x.h[x.hot]).tolist():
                by_count[h], mass[h] = hot_rows[int(x.hashes[h])]
        factor, left_mass = pairs.kept(x.history_count, by_count)
        low = words.p(x.count)
        back = np.where(x.history_count > 0, left_mass / np.maximum(1 - mass, 1e-300), 1.0)
        base = np.log10((x.count + 1.0) / (words.total + 1.0 * (words.kinds + 1)))
        p = np.empty(len(x.order))
        for i in range(0, len(p), SLICE):
            s = slice(i, i + SLICE)
            h, c = x.h[s], total[s]
            p[x.order[s]] = np.where(c > 0, factor[h] * pairs.mass(c) / np.maximum(x.history_count[h], 1), back[h] * low[x.w[s]])
        np.log10(p, out=p)
        sums = [np.add.reduceat(of[at], x.first) for of, at in (((x.count > 0).astype(np.int64), x.tokens), (base, x.tokens), (p, x.back))]
        arrays = [block["docs"], block["held"], x.sizes, sums[0], [words.total] * len(x.sizes), sums[1], sums[2]]
        return pa.table([pa.array(a, f.type) for a, f in zip(arrays, SCORE, strict=True)], schema=SCORE)

    return work


def katz_scores(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", block_tokens: int = 2_000_000) -> DataFrame:
    """Scores every document with the model of the rows that are not held out; held_out: a boolean column of ``docs``.

    The scores are written to the shared folder; the model's tables, several times the input, are dropped before it returns.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"))
    name = f"katz_blocks_{uuid.uuid4().hex}"
    try:
        return _scored(own, name, n, block_tokens)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name} PURGE")


def _scored(own: DataFrame, name: str, n: int, block_tokens: int) -> DataFrame:
    spark = own.sparkSession
    own.mapInArrow(_blocks(block_tokens), BLOCK_SQL).write.bucketBy(n, "block").option("compression", "none").saveAsTable(name)
    blocks = spark.table(name)
    sums = blocks.agg(F.sum("n_words"), F.sum("train_tokens"), F.sum("train_docs"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not sums[0]:
        return spark.createDataFrame([], SCORE_SQL)
    keys, train, starts, size = (int(x or 0) for x in sums)

    parts = -(-keys // CELL_KEYS)
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask_words(parts), CELL_SQL)
    counted, counted_at = stored_at(asked.groupBy("part").applyInArrow(_count_words, CELL_SQL), "katz-words")
    numbers = _added(counted.where("kind = 1"))
    words = Words(numbers[0], numbers[1], numbers[2:])

    parts, hot = -(-size // CELL_KEYS), max(1000, train // HOT_PARTS)
    word_cells = counted.where("kind = 0")
    whole = blocks.select(*(f.name for f in BLOCK))
    pairs_asked = whole.groupBy("block").cogroup(word_cells.select("block", "part", "a").groupBy("block")).applyInArrow(_ask_pairs(parts, hot, starts), ASK_SQL)
    pairs, pairs_at = stored_at(pairs_asked.groupBy("part").applyInArrow(_count_pairs(words), CELL_SQL), "katz-pairs")
    level = Level(_added(pairs.where("kind = 3")))
    hot_parts = pairs.where("kind = 4").select("a", "part", "numbers", "b").collect()  # at most HOT_PARTS histories in all their parts
    hot_rows: dict[int, tuple[list[int], float]] = {}
    for r in sorted(hot_parts, key=lambda r: (bytes(r["a"]), r["part"])):
        key = int(np.frombuffer(bytes(r["a"]), np.uint64)[0])
        before = hot_rows.get(key, ([0] * SMALL, 0.0))
        hot_rows[key] = ([x + y for x, y in zip(before[0], r["numbers"], strict=True)], before[1] + float(np.frombuffer(bytes(r["b"]), np.float64)[0]))
    cells = word_cells.union(pairs.where("kind = 2")).select("block", "part", "kind", "a", "b")
    out = stored(whole.groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(_score(words, level, hot_rows, parts, hot, starts), SCORE_SQL), "katz-scores")
    discard(spark, counted_at, pairs_at)
    return out


def _added(rows: DataFrame) -> list[int]:
    """Sums of the arrays of numbers, place by place."""
    each = rows.select(F.posexplode("numbers").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    return [int(r["x"]) for r in each]

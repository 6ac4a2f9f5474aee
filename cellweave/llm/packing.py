"""Cost-balanced sequence packing.

A sequence costs ``linear * length + quadratic * sum(piece length ** 2)``, the work of attention within pieces. Documents are
tokenised and packed where they are read, in blocks of a bounded number of tokens: no token is shuffled, a lost executor costs
its own blocks only, and memory does not depend on the size of the input. Within a block the pieces go, by descending cost, to
the open sequence of the lowest cost that still has room for them; a piece that fits nowhere is cut at the room that the
cheapest sequence has. The sequences of a block have ``length`` tokens each but for its last tokens, which make sequences whose
lengths are powers of two, as those need no padding. So no position is padded at all.

Defined results: a null text is packed as an empty one, that is as its end token; a document longer than a sequence is cut into
full sequences and a rest; repeated rows are packed one by one; doc_id may be null; other columns are not read; an empty table
gives no rows. Sequence ids are unique; they hold the partition and the block, so a repeated task gives the same ids.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
OUT = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


#: A chunk of Latin letters and closing ASCII marks but apostrophes: the tokenizer cuts it into the two, and lower-cases the first.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-^`{-~]*)")
#: Characters that str.split() takes for white space and the tokenizer does not.
CONTROL = "\x1c\x1d\x1e\x1f"


#: Words of a generation that an Encoder remembers.
REMEMBERED = 800_000


class Encoder:
    """Token ids of texts. White space ends a word in this vocabulary, so words are encoded once and looked up afterwards.

    Two generations of remembered words bound the memory: a full young one becomes the old one, and what is used again moves up.
    """

    def __init__(self, path: str, end: int, remembered: int = REMEMBERED):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.remembered = Tokenizer.from_file(path), end, remembered
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = json.loads(self.tokenizer.to_str())["model"]["vocab"]
        self.last = np.zeros(max(vocabulary.values()) + 1024, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words that are not in the young generation."""
        known, old = self.young, self.old
        if len(known) + 2 * len(words) > self.remembered:
            self.old, self.young = known, {}
            known, old = self.young, self.old
        parts, stems = {}, []
        for w in words:
            if (ids := old.get(w)) is not None:
                known[w] = ids
            elif m := PLAIN.fullmatch(w):
                stem = m[1].lower()
                parts[w] = stem, m[2]
                if stem not in known:
                    if (ids := old.get(stem)) is not None:
                        known[stem] = ids
                    else:
                        known[stem] = b""
                        stems.append(stem)
                if m[2] and m[2] not in known:
                    known[m[2]] = self._ids(m[2])
            else:
                known[w] = self._ids(w)
        if stems:  # each is one word of the vocabulary's rules, so exactly its last id ends a word
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(stops) != len(stems):
                raise RuntimeError("the vocabulary does not mark the ends of words")
            raw, start = ids.tobytes(), 0
            for stem, stop in zip(stems, stops, strict=True):
                known[stem] = raw[4 * start : 4 * stop]
                start = stop
        for w, (stem, marks) in parts.items():
            known[w] = known[stem] + known[marks] if marks else known[stem]

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        end = self.end.to_bytes(4, "little")
        if any(c in text for c in CONTROL):
            return np.frombuffer(self._ids(text) + end, "<u4")
        words = text.split()
        ids = list(map(self.young.get, words))
        if None in ids:
            new = dict.fromkeys(w for w, i in zip(words, ids, strict=True) if i is None)
            if 4 * len(new) > self.remembered:
                return np.frombuffer(self._ids(text) + end, "<u4")
            self._learn(list(new))
            known = self.young
            ids = [known[w] if i is None else i for w, i in zip(words, ids, strict=True)]
        return np.frombuffer(b"".join(ids) + end, "<u4")


@functools.cache
def encoder(path: str, end: int, remembered: int) -> Encoder:
    """One for each Python worker, which keeps its words from task to task."""
    return Encoder(path, end, remembered)


def capacities(total: int, length: int) -> np.ndarray:
    """Full sequences, then powers of two for what is left."""
    full, rest = divmod(total, length)
    return np.array([length] * full + [1 << k for k in range(length.bit_length(), -1, -1) if rest >> k & 1], np.int64)


def pack(sizes: np.ndarray, length: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of the given sizes, filling capacities() exactly."""
    room = capacities(int(sizes.sum()), length)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)
    out: list[tuple[int, int, int, int, int]] = []

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, s, int(used[s])))
        used[s] += n
        room[s] -= n
        cost[s] = cost[s] + linear * n + quadratic * n * n if room[s] else np.inf

    rests: list[tuple[int, int, int]] = []  # size, document, start
    opened = 0
    for d, n in enumerate(sizes.tolist()):
        start = 0
        while n - start >= length and opened < len(room) and room[opened] == length:
            put(d, start, length, opened)
            opened, start = opened + 1, start + length
        if n > start:
            rests.append((n - start, d, start))
    rests.sort(key=lambda x: (-x[0], x[1], x[2]))
    for n, d, start in rests:
        while n:
            fits = np.where(room >= n, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(n, int(room[s]))
            put(d, start, part, s)
            n, start = n - part, start + part
    return out


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048, end: int = 1, block_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1.0 / 2048, remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece: document, start, length, CRC-32 of its ids, tokens of the document, sequence, and offset there.

    tokenizer: file of a public tokenizer, to be found on every executor; end: id after each document; block_tokens: tokens that
    are packed together at least (a block ends with the document that reaches them); remembered: words that a worker remembers
    in each of two generations, some 200 bytes a word, which bears on memory and time but not on the result.
    """
    from pyspark.sql import functions as F

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, end, remembered)
        base = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, np.ndarray]] = []
        n = 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal base, held, n
            pieces = pack(np.array([len(i) for _, i in held], np.int64), length, linear, quadratic)
            if pieces:
                rows = [(held[d][0], start, k, zlib.crc32(held[d][1][start : start + k].tobytes()), len(held[d][1]), base + s, at) for d, start, k, s, at in pieces]
                base += max(p[3] for p in pieces) + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=OUT)
            held, n = [], 0

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(x.as_py())
                held.append((i, ids))
                n += len(ids)
                if n >= block_tokens:
                    yield from done()
        yield from done()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(blocks, SCHEMA)

"""Word shingles as 64-bit hashes, and universal min-hashes over them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Seed of the hash functions: x -> a * x + b modulo 2 ** 32 with an odd a, whose high half is then mixed into its low half.
_SEED = 20240229


class _Words(dict):
    """Hashes of words, kept within a worker; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes; with fewer words, the whole sequence as one; none without words.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased, as bytes.split() and bytes.lower() have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    ids = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(ids) - width + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def set_key(shingles: np.ndarray) -> bytes:
    """A 128-bit digest: equal for equal sets."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 2**32, k, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, np.uint64).astype(np.uint32)


def signatures(sets: list[np.ndarray], family: tuple[np.ndarray, np.ndarray], block: int = 1 << 15) -> np.ndarray:
    """The minimum of every hash function over each non-empty set: one row a set."""
    a, b = family
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= block):
            n, j = n + len(sets[j]), j + 1
        flat = np.concatenate(sets[i:j])
        x = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[i : j - 1]])]).astype(np.int64)
        t = np.empty_like(x)
        for k in range(len(a)):
            np.multiply(x, a[k], out=t)
            np.add(t, b[k], out=t)
            t ^= t >> np.uint32(15)
            out[i:j, k] = np.minimum.reduceat(t, starts)
        i = j
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` minima; bands never share keys by construction of the seed."""
    bands = sig.shape[1] // rows
    s = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
    for r in range(rows):
        h = (h ^ s[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return h.view(np.int64)

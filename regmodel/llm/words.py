"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of word bytes of the UTF-8 text; its hash is a polynomial over its bytes modulo 2**64.
Work is done in slices of about ``SLICE`` bytes, so memory does not follow the size of an Arrow batch.  One text longer
than a slice is hashed in pieces that end between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def byte_table(spaces: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words: all but ``spaces``, or by default ASCII letters, digits and bytes of other characters."""
    if spaces is not None:
        out = np.ones(256, bool)
        out[list(spaces)] = False
        return out
    out = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        out[lo : hi + 1] = True
    return out


ALNUM = byte_table()
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_KEEP = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and offsets (one more than texts)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _piece(raw: np.ndarray, bounds: np.ndarray, word: np.ndarray, fold: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and number of words of each text, for raw[bounds[0]:bounds[-1]]; with prefixes, hashes has a row for whole
    words and one for the first so many bytes of each."""
    lo, hi = int(bounds[0]), int(bounds[-1])
    data = raw[lo:hi]
    n_texts = len(bounds) - 1
    none = np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)
    if not len(data):
        return none, np.zeros(n_texts, np.int64)
    inside = word[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = bounds[:-1] - lo
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return none, np.zeros(n_texts, np.int64)
    kept = fold[data[inside]]
    first = np.cumsum(inside)[starts] - 1
    lens = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, lens)
    terms = _powers(int(lens.max()))[place]
    terms *= kept.astype(np.uint64) + np.uint64(1)
    hashes = mix(np.add.reduceat(terms, first))
    if prefixes:
        hashes = np.stack([hashes, *(mix(np.add.reduceat(np.where(place < k, terms, np.uint64(0)), first)) for k in prefixes)])
    counts = np.diff(np.searchsorted(starts, bounds - lo))
    return hashes, counts


def hashed(column: pa.Array, word: np.ndarray = ALNUM, lower: bool = True, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of the column: (index of its first text, word counts of its texts, hashes of all their words in order)."""
    raw, offsets = buffers(column)
    fold = _LOWER if lower else _KEEP
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1
        j = min(max(j, i + 1), n)
        if j == i + 1 and offsets[j] - offsets[i] > SLICE:
            parts, at, end = [], int(offsets[i]), int(offsets[j])
            while at < end:
                to = min(at + SLICE, end)
                while to < end and word[raw[to - 1]] and word[raw[to]]:
                    to += 1
                parts.append(_piece(raw, np.array([at, to]), word, fold, prefixes)[0])
                at = to
            h = np.concatenate(parts, axis=-1)
            yield i, np.array([h.shape[-1]]), h
        else:
            h, counts = _piece(raw, offsets[i : j + 1], word, fold, prefixes)
            yield i, counts, h
        i = j


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of given words, as ``hashed`` gives them."""
    out = [h for _, _, h in hashed(pa.array([" ".join(words)]))]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def grams(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, their text's index in the slice and their start within the text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
    g = h[:n].copy()
    for x in range(1, k):
        g *= _STEP
        g += h[x : n + x]
    g, d = mix(g[whole]), doc[whole]
    return g, d, whole - first[d]

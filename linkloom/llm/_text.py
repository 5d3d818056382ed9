"""Words and n-grams of Arrow string batches as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return (np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with up to most bytes in a string column (one row may have more): bounds what numpy holds at once."""
    _, offsets = buffers(batch.column(column))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=4)
def _tables(fold: bool, letters: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte (A-Z as a-z if fold), and which bytes are white space (if letters, also ASCII marks and digits)."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold:
        values[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    if letters:
        space[[b for b in range(33, 127) if not chr(b).isalpha()]] = True
    return values, space


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASE) | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool, letters: bool = False, head: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document (row) of each stretch without ASCII white space (if letters, without ASCII marks and digits too), in order.

    head: only so many bytes of each are hashed, all if 0.

    A word's hash is a polynomial of its bytes, got from running sums, so whole blocks of text are
    hashed at once. Blocks end at white space or between documents.
    """
    values, space = _tables(fold, letters)
    hashes, docs = [], []
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(lo + BLOCK, end)
        while hi < end and not space[data[hi]]:
            if offsets[np.searchsorted(offsets, hi)] == hi:
                break
            hi += 1
        part = data[lo:hi]
        inside = ~space[part]
        first = np.zeros(len(part) + 1, bool)
        cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        first[cuts] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:-1]
        ends[:-1] &= ~inside[1:] | first[1:-1]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = _powers(1 << max(20, (hi - lo).bit_length()))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values[part] * up[: len(part)], out=sums[1:])
        e = np.minimum(e, s + head) if head else e
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        docs.append(np.searchsorted(offsets, s + lo, "right") - 1)
        lo = hi
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(docs)


def shingles(words: np.ndarray, docs: np.ndarray, rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each k words in a row; a document of fewer words, but some, is one shingle."""
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * factors[j]
    full = docs[:n] == docs[k - 1 : k - 1 + n]
    h, d = mix(h[full]), docs[:n][full]
    counts = np.bincount(docs, minlength=rows) if len(docs) else np.zeros(rows, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(counts)])
        own = []
        for r in short:
            w = words[starts[r] : starts[r] + counts[r]]
            own.append((w * factors[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w)))
        h, d = np.concatenate([h, mix(np.array(own, np.uint64))]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d

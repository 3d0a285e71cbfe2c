"""Distinct word shingles of whole texts as 64-bit hashes, computed for many texts at once in numpy."""

from __future__ import annotations

import functools

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, base, _U)]))


def word_hashes(texts: list[bytes], block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased), and the number of words of each text. Worked on in blocks of about `block` bytes, cut between words."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    blank = np.ones(len(data) + 1, bool)
    blank[1:] = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    ends = np.append(ends, len(data))[: len(starts)]
    hashes, at = np.zeros(len(starts), _U), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + block)))
        first, last = int(starts[at]), int(ends[to - 1])
        size = 1 << max(16, (last - first).bit_length())
        sums = np.zeros(last - first + 1, _U)
        np.cumsum((_LOWER[data[first:last]].astype(_U) + _U(1)) * _powers(_BASE, size)[: last - first], out=sums[1:])
        begun, done = starts[at:to] - first, ends[at:to] - first
        hashes[at:to] = mix((sums[done] - sums[begun]) * _powers(_INVERSE, size)[begun] + _U(0xD6E8FEB86659FD93) * (done - begun).astype(_U))
        at = to
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one after another, and how many each text has.

    A text of fewer words than a shingle has its whole sequence as its one shingle; one without words has none."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    factors = mix(np.arange(1, words + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
    rolled = np.zeros(max(0, n - words + 1), _U)
    for j in range(words):
        rolled += hashes[j : j + len(rolled)] * factors[j]
    rolled = mix(rolled)
    out, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for i, c in enumerate(counts.tolist()):
        if c >= words:
            own = np.unique(rolled[at : at + c - words + 1])
        elif c:
            own = mix((hashes[at : at + c] * factors[:c]).sum(keepdims=True, dtype=_U) + _U(c))
        else:
            own = hashes[:0]
        at += c
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else hashes[:0]), sizes


def minhashes(sets: np.ndarray, sizes: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """count 32-bit minima for each set that isn't empty."""
    full = np.flatnonzero(sizes)
    out = np.zeros((len(full), count), np.uint32)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        factors = mix(np.arange(1, count + 1, dtype=_U) + _U(seed << 32)) | _U(1)
        for j in range(count):
            out[:, j] = np.minimum.reduceat(sets * factors[j], starts) >> _U(32)
    return out


def chunks(texts: list, most: int = 1_000_000):
    """Runs of texts, or of tuples of texts, of about `most` bytes (or characters)."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) if isinstance(t, (bytes, str)) else sum(map(len, t))
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def slices(batches, rows: int = 200):
    """The batches in pieces of at most `rows` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

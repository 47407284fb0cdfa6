"""Word shingles of whole Arrow batches as 64-bit hashes, by array operations.

Bytes of all texts of a batch are hashed with running sums of table values times powers of an odd number, so the hash of
any word is a difference of two sums; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from palimpsest.llm.remembered import begins

_rng = np.random.default_rng(20240229)
_OF_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OF_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OF_BYTE = _OF_BYTE[_LOWER]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _no_powers() -> None:
    _powers[:] = [x[:1].copy() for x in _powers]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lowered, and the index of each one's text. Nulls have none."""
    begins("shingles", _no_powers)
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(bounds[0]), int(bounds[-1])
    if hi == lo:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi]
    bounds = bounds - lo
    word = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a text begins here
    edge[bounds[:-1]] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    powers, inverse = _power(len(raw) + 1)
    sums = np.empty(len(raw) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_OF_BYTE[raw] * powers[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(bounds, starts, side="right") - 1


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of text i, ascending, are hashes[bounds[i]:bounds[i + 1]].

    A text of fewer words has one shingle, of all its words; a text without words has none.
    """
    w, of = word_hashes(texts)
    count = np.bincount(of, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])
    n = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    long = np.repeat(count >= words, n)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], n)  # a shingle's first word
    run = at[long]
    total = np.zeros(len(run), dtype=np.uint64)
    for k in range(words):
        total += mixed(w[run + k] + _OF_PLACE[k]) * _OF_PLACE[k]
    out[long] = mixed(total)
    for i in np.flatnonzero((count > 0) & (count < words)):
        own = w[first[i] : first[i + 1]]
        whole = (mixed(own + _OF_PLACE[: len(own)]) * _OF_PLACE[: len(own)]).sum(dtype=np.uint64)
        out[bounds[i]] = mixed(whole[None] + _OF_PLACE[32 + len(own)])[0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][n > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[bounds]

"""Words and word shingles of many texts as flat numpy arrays of 64-bit fingerprints.

A word is a run of letters and digits; case and everything else are ignored.
No Python object is made per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SHINGLE = 5
#: UTF-8 bytes taken up at a time; a longer text is taken alone.
PORTION = 2_000_000

# A word byte is an ASCII letter or digit, or any byte of a longer character.
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
# Characters beyond ASCII that are no letter or digit, for texts that have them.
_MARKS = re.compile(r"[^\w\x00-\x7f]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _STEP, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= len(_POWERS) else np.cumprod(np.full(n, _STEP, np.uint64), dtype=np.uint64)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of all texts in order, and the bounds of each text in them (one more than texts)."""
    return runs([_MARKS.sub(" ", (t or "").lower()).replace("_", " ").encode("utf-8", "replace") for t in texts])


def runs(plain: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, of texts in lower case whose runs of word bytes are the words."""
    sizes = np.array([len(p) + 1 for p in plain], np.int64)
    data = np.frombuffer(b"\n".join(plain) + b"\n", np.uint8) if plain else np.zeros(0, np.uint8)
    is_word = _WORD[data]
    edge = np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(begin):
        return np.zeros(0, np.uint64), bounds
    length = end - begin
    inside = data[is_word].astype(np.uint64) + np.uint64(1)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, length)
    inside *= _powers(int(length.max()))[place]
    return mix(np.add.reduceat(inside, first) + length.astype(np.uint64)), bounds


def shingles(word: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle fingerprints and their bounds; a text of fewer words, but at least one, has one shingle of them all."""
    counts = np.diff(bounds)
    each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(each)])
    total = int(out_bounds[-1])
    owner = np.repeat(np.arange(len(counts)), each)
    at = np.arange(total) - np.repeat(out_bounds[:-1], each) + bounds[:-1][owner]
    powers = _powers(size)
    value = np.zeros(total, np.uint64)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    last = bounds[1:][owner]
    for j in range(size):
        here = padded[at + j]
        short = at + j >= last
        if short.any():
            here = np.where(short, np.uint64(0), here)
        value += here * powers[j]
    return mix(value), out_bounds


def portions(texts: list[str | None], size: int = PORTION) -> Iterator[tuple[int, int]]:
    """Bounds of stretches with at most so many characters, or one text."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > begin and total + n > size:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, sorted, and how often each comes."""
    return np.unique(values, return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over the sum of the greater counts; 0 if both are empty."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    high = int(a[1].sum() + b[1].sum()) - low
    return low / high if high else 0.0

"""Word hashes of UTF-8 texts in numpy, for operators that scan whole texts.

Letters A-Z count as lower case. By ALNUM a word is a run of ASCII letters and
digits and of any bytes from 128 on; by SPACED it is a run of anything but
white space (space, tab to carriage return). A word's hash is a polynomial in
its bytes modulo 2^64, taken from prefix sums, so long words cost no more than
short ones.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = np.asarray([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: By byte: 0 where words end, else the lower-case byte; the byte 0 within a word counts as 256.
ALNUM = np.asarray([_LOWER[c] if c >= 128 or chr(c).isalnum() else 0 for c in range(256)], np.uint8)
SPACED = np.asarray([0 if c == 32 or 9 <= c <= 13 else _LOWER[c] for c in range(256)], np.uint16)
SPACED[0] = 256
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, _INVERSE)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and last+1 of each word, and words by text. Words don't reach over texts."""
    letter = (fold != 0)[raw]
    before = np.empty_like(letter)
    before[:1] = False
    before[1:] = letter[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    before[inner] = False
    begin = np.flatnonzero(letter & ~before)
    after = np.empty_like(letter)
    after[-1:] = False
    after[:-1] = letter[1:]
    if len(inner):
        after[inner[inner > 0] - 1] = False
    end = np.flatnonzero(letter & ~after) + 1
    n = np.diff(np.searchsorted(begin, offsets))
    return begin, end, n


def prefix_sums(raw: np.ndarray, fold: np.ndarray = ALNUM) -> np.ndarray:
    forward, _ = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(fold.astype(np.uint64)[raw] * forward[: len(raw)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, backward = _power(len(sums))
    return mix((sums[end] - sums[begin]) * backward[begin])


def shingle_hashes(word: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words of each text, and their number by text.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    first = np.cumsum(n) - n
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    start = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    have = np.minimum(np.repeat(n, count), size)
    out = have.astype(np.uint64)
    padded = np.append(word, np.zeros(size, np.uint64))
    for k in range(size):
        w = padded[start + k]
        if k:
            w = np.where(have > k, w, np.uint64(0))
        out = (out + w) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out), count

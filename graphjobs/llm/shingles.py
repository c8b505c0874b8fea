"""Word shingles of whole texts, hashed to 64 bits with numpy over flat Arrow buffers.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased. A document's set holds its distinct
five-word shingles; a shorter text counts as one shingle of all its words; a text without words
(or null) has the empty set. Sets are sets of 64-bit hashes: a chance collision inside one
compared pair of documents needs about 2**32 shingles to become likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes of text hashed at once; bounds memory whatever the text's length
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    code = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[lower]
    sep = np.zeros(256, bool)
    sep[[32, *range(9, 14)]] = True
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers, back = np.full(BLOCK, base, _U), np.full(BLOCK, inverse, _U)
    powers[0] = back[0] = 1
    return code, sep, np.multiply.accumulate(powers), np.multiply.accumulate(back)


_CODE, _SEP, _POW, _BACK = _tables()
_MULT = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Final scrambling of 64-bit values, a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most BLOCK bytes; words end at cuts too."""
    gap = _SEP[data]
    word = ~gap
    first = word.copy()
    first[1:] &= gap[:-1]
    inside = cuts[(cuts > 0) & (cuts < len(data))]
    first[inside] = word[inside]
    last = word.copy()
    last[:-1] &= gap[1:]
    last[inside - 1] = word[inside - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    sums = np.cumsum(_CODE[data] * _POW[: len(data)], dtype=_U)
    h = sums[end]
    later = start > 0
    h[later] -= sums[start[later] - 1]
    return mix(h * _BACK[start] + (end - start + 1).astype(_U)), start


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column in order, and each row's number of words."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    counts = np.zeros(len(column), np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, _U), counts
    data = np.frombuffer(column.buffers()[2], np.uint8)
    parts, at, stop = [], int(offsets[0]), int(offsets[-1])
    while at < stop:
        to = min(at + BLOCK, stop)
        if to < stop:  # end a block after a separator or at a row's end, unless a word fills it
            edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            gaps = np.flatnonzero(_SEP[data[max(edge, at) : to]])
            cut = max(edge, at) + int(gaps[-1]) + 1 if len(gaps) else edge
            if cut > at:
                to = cut
            else:
                to, h = _giant(data, at, stop, offsets)
                parts.append(h)
                counts[np.searchsorted(offsets, at, "right") - 1] += len(h)
                at = to
                continue
        lo, hi = np.searchsorted(offsets, [at, to])
        h, start = _words(data[at:to], offsets[lo:hi] - at)
        parts.append(h)
        counts += np.bincount(np.searchsorted(offsets, start + at, "right") - 1, minlength=len(counts))[: len(counts)]
        at = to
    return np.concatenate(parts), counts


def _giant(data: np.ndarray, at: int, stop: int, offsets: np.ndarray) -> tuple[int, np.ndarray]:
    """One word longer than a block: its end, and its hash block by block."""
    end = int(offsets[np.searchsorted(offsets, at, "right")])
    total, scale, pos = 0, 1, at
    step = pow(0x9E3779B97F4A7C15, BLOCK, 1 << 64)
    while pos < end:
        part = data[pos : min(pos + BLOCK, end)]
        gaps = np.flatnonzero(_SEP[part])
        part = part[: gaps[0]] if len(gaps) else part
        total = (total + scale * int((_CODE[part] * _POW[: len(part)]).sum(dtype=_U))) % (1 << 64)
        pos, scale = pos + len(part), scale * step % (1 << 64)
        if len(gaps):
            break
    return pos, mix(np.array([(total + pos - at) % (1 << 64)], _U))


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each row, its set of shingle hashes: sorted, distinct, unsigned."""
    hashes, counts = word_hashes(column)
    n = len(hashes)
    grams = np.zeros(max(0, n - size + 1), _U)
    for i in range(size if n >= size else 0):
        grams += hashes[i : n - size + 1 + i] * _MULT[i % 5] * _U(2 * (i // 5) + 1)
    grams = mix(grams)
    at = 0
    for c in counts.tolist():
        if c >= size:
            s = np.sort(grams[at : at + c - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif c:
            short = hashes[at : at + c] * _MULT[np.arange(c) % 5]
            yield mix(short.sum(dtype=_U, keepdims=True) + _U(c))
        else:
            yield np.zeros(0, _U)
        at += c

"""Word and shingle hashes of whole texts, by numpy over Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; no
byte of a longer UTF-8 sequence is among these, so bytes and code points agree.
A word's hash is a polynomial over random byte values modulo 2**64, read off a
prefix array and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 1 << 19

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose texts have about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts in order, and where each text's words start among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~space
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= edge[:n]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= edge[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    power, inverse = _power_arrays(n + 1)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[data] * power[:n], out=prefix[1:])
    hashes = (prefix[ends] - prefix[starts]) * inverse[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, and where each text's start.

    A text of fewer words, but one at least, has one: that of the whole sequence.
    """
    count = np.diff(at)
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(per)))
    total = int(out_at[-1])
    doc = np.repeat(np.arange(len(per)), per)
    first = np.arange(total) - out_at[:-1][doc] + at[:-1][doc]
    length = np.minimum(count, k)[doc]
    acc = np.zeros(total, np.uint64)
    if not total:
        return acc, out_at
    top = len(hashes) - 1
    for j in range(k):
        part = hashes[np.minimum(first + j, top)] * _STEP[j]
        if j:
            part[length <= j] = 0
        acc += mix(part)
    return mix(acc + length.astype(np.uint64) * _STEP[63]), out_at


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's index and its sorted distinct shingle hashes."""
    data, offsets = raw(texts)
    for first, last in chunks(offsets):
        own = offsets[first : last + 1]
        h, at = words(data[own[0] : own[-1]], own - own[0])
        s, at = shingles(h, at, k)
        for i in range(last - first):
            yield first + i, np.unique(s[at[i] : at[i + 1]])

"""Words of Arrow texts as arrays of 64-bit hashes, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in pieces of about so many bytes (a longer text alone), so that arrays a byte stay small.
PIECE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The odd factor of a running hash over words, and its inverse modulo 2**64.
_STEP = 0xD1342543DE82EF95
_UNSTEP = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of some texts: ``first[d]:first[d + 1]`` are those of text d."""

    first: np.ndarray
    hash: np.ndarray
    start: np.ndarray  #: where a word starts in ``data``
    end: np.ndarray
    data: np.ndarray  #: UTF-8 bytes of the texts, one after the other

    def word_of(self, d: int) -> slice:
        return slice(self.first[d], self.first[d + 1])


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + size, "right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi


def words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of ``texts`` (null: none); ``lower``: A to Z count as a to z in the hashes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64), none, none, data)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:][~solid] = True
    edge[:-1][~solid] = True
    start = np.flatnonzero(solid & edge[:-1])
    end = np.flatnonzero(solid & edge[1:]) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64), none, none, data)
    length = end - start
    at = np.flatnonzero(solid)
    begin = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(begin, length)
    value = (_LOWER if lower else _BYTE)[data[at]] * powers(int(_BASE), int(length.max()) + 1)[place]
    hashed = mix(np.add.reduceat(value, begin) + length.astype(np.uint64))
    return Words(np.searchsorted(start, offsets), hashed, start, end, data)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of stretches of ``data``, none of them empty, as ``words`` gives them to words of the same bytes."""
    length = end - start
    begin = np.cumsum(length) - length
    place = np.arange(length.sum()) - np.repeat(begin, length)
    value = (_LOWER if lower else _BYTE)[data[np.repeat(start, length) + place]] * powers(int(_BASE), int(length.max()) + 1)[place]
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64))


class Running:
    """Hashes of runs of words, each run in a step, from sums over all words."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_STEP, len(hashes)), out=self.sums[1:])
        self.back = powers(_UNSTEP, len(hashes) + 1)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64))


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list array of ``values`` cut into lists of ``counts``."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

"""Words and their hashes for whole Arrow batches, with NumPy over the UTF-8 bytes instead of a loop over words.

A word hash is a polynomial over the word's bytes modulo 2**64, read off prefix sums, then mixed; an n-gram hash is a
polynomial over word hashes, mixed again. Work goes in chunks of whole texts of about CHUNK bytes, so memory does not
follow the batch (a single longer text is its own chunk).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX_A, MIX_B, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def table(separators: bytes | None = None, keep: bytes | None = None) -> np.ndarray:
    """Which byte values belong to words."""
    out = np.ones(256, dtype=bool)
    if separators is not None:
        out[list(separators)] = False
    if keep is not None:
        out[:] = False
        out[list(keep)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but these six.
SPACE_WORDS = table(separators=b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters and digits and of non-ASCII characters.
ALNUM_WORDS = table(keep=bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k word hashes from each one on."""
    if len(h) < k:
        return h[:0]
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * STEP + h[j : len(h) - k + 1 + j]
    return mix(out + np.uint64(k))


@dataclass
class Chunk:
    """Texts first to first + len(bounds) - 2 of the batch; words bounds[i] to bounds[i + 1] are those of text i."""

    first: int
    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningful only where they are of one text."""
        return grams(self.hashes, k)

    def whole(self, i: int) -> np.ndarray:
        """Hash of all words of text i, equal to what grams gives for that many words."""
        h = self.hashes[self.bounds[i] : self.bounds[i + 1]]
        out = h[:1].copy()
        for x in h[1:]:
            out = out * STEP + x
        return mix(out + np.uint64(len(h)))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of each text; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(column: pa.Array, words: np.ndarray = SPACE_WORDS, lower: bool = False) -> Iterator[Chunk]:
    if not len(column):
        return
    data, offsets = as_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        last = min(last, n)
        at = offsets[first : last + 1] - offsets[first]
        raw = data[offsets[first] : offsets[last]]
        raw = LOWER[raw] if lower else raw
        m = len(raw)
        inside = np.zeros(m + 2, dtype=bool)
        inside[1:-1] = words[raw]
        cut = np.zeros(m + 1, dtype=bool)
        cut[at] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        up, down = powers(m + 1)
        sums = np.zeros(m + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:m], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        yield Chunk(first, raw, at, starts, ends, hashes, np.searchsorted(starts, at))
        first = last


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

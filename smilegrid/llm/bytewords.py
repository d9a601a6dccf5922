"""Words of many texts at once: vectorised splitting and hashing over UTF-8 bytes.

All word rules of this package separate words by ASCII characters only, so they
can be applied to UTF-8 bytes. A word is identified by a 64-bit hash of its
bytes; two different words, or two different runs of words, agree by chance
with probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordRule:
    """Which bytes belong to words, and which bytes count as equal."""

    def __init__(self, separators: bytes):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        folded = np.arange(256, dtype=np.uint64)
        folded[65:91] += np.uint64(32)  # A-Z to a-z
        self.value = mix(folded + np.uint64(1)) | np.uint64(1)
        self._powers = np.ones(1, dtype=np.uint64)
        self._inverse = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n:
            size = max(n, BLOCK + 4096)
            steps = np.full(size, _BASE, dtype=np.uint64)
            steps[0] = 1
            self._powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = np.uint64(_inverse(int(_BASE)))
            self._inverse = np.cumprod(steps, dtype=np.uint64)
        return self._powers[:n], self._inverse[:n]


#: Words separated by white space: space and the control characters 9 to 13.
SPACED = WordRule(bytes([0x20, 9, 10, 11, 12, 13]))
#: Words of ASCII letters and digits and of all characters beyond ASCII.
ALPHANUMERIC = WordRule(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]) )
ALPHANUMERIC.inside[65:91] = True  # upper case is folded before the words are taken


@dataclass
class Words:
    """Hashes of all words in order, and the number of words of each text."""

    hashes: np.ndarray
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 bounds of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = int(bounds[0]) if len(bounds) else 0
    return every[first : int(bounds[-1])], bounds - first


def _block_words(data: np.ndarray, opens: np.ndarray, rule: WordRule) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of a block; `opens` marks first bytes of texts."""
    inside = rule.inside[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | opens))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:] & ~opens[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    power, inverse = rule.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(rule.value[data] * power[:-1], dtype=np.uint64, out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, mix(raw + (ends - starts).astype(np.uint64))


def words(column: pa.Array, rule: WordRule) -> Words:
    """The words of every text, split in blocks of about a megabyte so that memory
    beside the result stays bounded for long texts too."""
    data, bounds = text_bytes(column)
    n = len(bounds) - 1
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[bounds[:-1]] = True
    hashes, places = [], []
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data) and not opens[end]:
            tail = np.flatnonzero(~rule.inside[data[at:end]] | opens[at:end])
            if len(tail) and tail[-1] > 0:
                end = at + int(tail[-1])
            else:  # one word fills the block: go on to its end
                while end < len(data) and rule.inside[data[end]] and not opens[end]:
                    step = ~rule.inside[data[end : end + BLOCK]] | opens[end : min(end + BLOCK, len(data))]
                    stop = np.flatnonzero(step)
                    end += int(stop[0]) if len(stop) else len(step)
        s, h = _block_words(data[at:end], opens[at:end], rule)
        places.append(s + at)
        hashes.append(h)
        at = end
    where = np.concatenate(places) if places else np.empty(0, np.int64)
    cuts = np.searchsorted(where, bounds)
    return Words(np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.diff(cuts) if n else np.empty(0, np.int64))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` consecutive words; entry i starts at word i."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= _BASE
        out += hashes[k : k + n]
    return mix(out)


def whole_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence, as `run_hashes` gives it for that length."""
    return run_hashes(hashes, len(hashes))[0]


def row_groups(batch_bytes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `most` bytes; a longer text is a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(batch_bytes.tolist()):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(batch_bytes):
        yield start, len(batch_bytes)

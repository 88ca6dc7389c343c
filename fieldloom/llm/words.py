"""Finding and hashing words over Arrow string columns, many documents at once.

The helpers work on the UTF-8 bytes that Spark hands over, without building a
Python string per word.  Both word rules used in this subpackage are decided
byte by byte, because every byte of a multi-byte character is 0x80 or above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once; one longer document is taken alone.
CHUNK_BYTES = 1 << 21
#: Longer words are hashed one by one.
LANE_BYTES = 256

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


@dataclass(frozen=True)
class WordRule:
    """Which bytes belong to words, and whether A-Z counts as a-z."""

    separators: tuple[tuple[int, int], ...]
    fold_case: bool

    def word_bytes(self) -> np.ndarray:
        table = np.ones(256, dtype=bool)
        for low, high in self.separators:
            table[low : high + 1] = False
        return table

    def letters(self) -> np.ndarray:
        """The byte that each byte stands for after folding."""
        table = np.arange(256, dtype=np.uint8)
        if self.fold_case:
            table[65:91] += 32
        return table


#: ``[^\x20\x09-\x0D]+`` with the case kept, and with A-Z lowered.
SPACED = WordRule(((0x09, 0x0D), (0x20, 0x20)), False)
SPACED_LOWER = WordRule(((0x09, 0x0D), (0x20, 0x20)), True)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering A-Z.
ALNUM_LOWER = WordRule(((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)), True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Words of consecutive rows ``row .. row + n - 1`` of a batch."""

    row: int
    data: np.ndarray  # the bytes of the rows
    bounds: np.ndarray  # n + 1 byte offsets of the rows
    first: np.ndarray  # n + 1 word numbers: row i has words first[i] .. first[i+1]
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    hashes: np.ndarray | None

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def position(self) -> np.ndarray:
        """The place of each word in its own row, from 0."""
        return np.arange(len(self.start)) - np.repeat(self.first[:-1], self.counts())


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at, raw


def chunks(column: pa.Array, rule: WordRule, hashed: bool = True, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of a string column, some rows at a time and in row order."""
    at, raw = string_buffers(column)
    n, row = len(at) - 1, 0
    member = rule.word_bytes()
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        stop = min(stop, n)
        bounds = at[row : stop + 1] - at[row]
        data = raw[at[row] : at[stop]]
        yield _chunk(row, data, bounds, member, rule.letters() if hashed else None)
        row = stop


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Each word's eight bytes after eight bytes, scrambled in turn; its length is the seed."""
    folded = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(letters, data, out=folded[: len(data)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=folded, strides=(1,))  # those that begin at each byte
    size = end - start
    out = mix(size.astype(np.uint64) * _STEP ^ (eights[start] & _LANE[np.minimum(size, 8)]))
    at, done = np.flatnonzero(size > 8), 8
    while len(at) and done < LANE_BYTES:
        left = size[at] - done
        out[at] = mix((out[at] + _STEP) ^ (eights[start[at] + done] & _LANE[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in at.tolist():
        out[i] = xxhash.xxh3_64_intdigest(folded[start[i] : end[i]].tobytes(), seed=int(out[i]))
    return out


def _chunk(row: int, data: np.ndarray, bounds: np.ndarray, member: np.ndarray, letters: np.ndarray | None) -> Chunk:
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return Chunk(row, data, bounds, np.zeros(len(bounds), dtype=np.int64), none, none, None if letters is None else none.astype(np.uint64))
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(bounds))
    head, tail = bounds[:-1][filled], bounds[1:][filled] - 1
    begins[head] = inside[head]
    ends[tail] = inside[tail]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    hashes = None if letters is None else _word_hashes(data, start, end, letters)
    return Chunk(row, data, bounds, first, start, end, hashes)


def join_pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two ordered hashes."""
    return mix(left * _MIX1 + (right ^ _STEP))


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, over row borders too."""
    if len(hashes) < width:
        return hashes[:0]
    parts, have, power, done = hashes, None, 1, 0
    left = width
    while left:
        if left & 1:
            piece = parts[done:]
            if have is None:
                have = piece
            else:
                m = min(len(have), len(piece))
                have = join_pair(have[:m], piece[:m])
            done += power
        left >>= 1
        if left:
            parts = join_pair(parts[:-power], parts[power:])
            power *= 2
    return have[: len(hashes) - width + 1]


def run_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the words that begin a run inside one row."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, dtype=np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(skip, counts) + np.repeat(first[:-1], counts)


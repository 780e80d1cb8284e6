"""Hashes of words and word shingles for whole Arrow batches at once.

Works on the UTF-8 bytes of an Arrow string column without making Python
strings.  Words are maximal runs of bytes other than space, tab, LF, VT, FF
and CR; A-Z are lower-cased.  A word's bytes are taken eight at a time; each
block is scrambled together with its place in the word, and the scrambled
blocks and the word's length are added up and scrambled again.  No step is
linear in the bytes, so words of a regular build do not collide by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text taken at once, and bytes hashed at once, which need some hundred times the room.
PIECE_BYTES, HASHED_BYTES = 1_000_000, 250_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Word hashes of some texts: text ``i`` owns ``bounds[i]:bounds[i+1]``."""

    hashes: np.ndarray
    bounds: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes of text each."""
    _, ends = text_buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def in_pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``PIECE_BYTES`` of one text column."""
    for batch in batches:
        for first, last in pieces(batch.column(column)):
            yield batch.slice(first, last - first)


def words(column: pa.Array) -> Words:
    """Hashes of every word of every text."""
    data, ends = text_buffers(column)
    if not len(data):
        return Words(np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = solid[inner]
    closes[inner - 1] = solid[inner - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(_word_hashes(_LOWER[data], starts, stops - starts), np.searchsorted(starts, ends))


def _word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the words ``data[starts[i]:starts[i] + lengths[i]]``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    first = eights[starts]
    short = np.minimum(lengths, 8).astype(np.uint64)
    total = mix(first & _KEPT[short]) + lengths.astype(np.uint64) * _STEP
    long = np.flatnonzero(lengths > 8)
    if len(long):  # the blocks after the first of longer words
        blocks = (lengths[long] - 1) // 8
        ends = np.cumsum(blocks)
        place = np.arange(ends[-1]) - np.repeat(ends - blocks, blocks) + 1
        left = np.minimum(np.repeat(lengths[long], blocks) - place * 8, 8).astype(np.uint64)
        more = mix(eights[np.repeat(starts[long], blocks) + place * 8] & _KEPT[left])
        more = mix(more + place.astype(np.uint64) * _STEP)
        total[long] += np.add.reduceat(more, ends - blocks)
    return mix(total)


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and their bounds per text.

    A text of fewer words gives its whole sequence as one shingle, a text
    without words none.  Repeats are kept.
    """
    counts = np.diff(found.bounds)
    out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out, out=bounds[1:])
    weights = mix(np.arange(1, width + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    owner = np.repeat(np.arange(len(counts)), out)
    first = np.arange(bounds[-1]) - bounds[owner] + found.bounds[owner]
    total = np.full(len(first), weights[width], np.uint64)
    last = len(found.hashes) - 1
    for k in range(width):
        inside = first + k < found.bounds[owner + 1]
        total += np.where(inside, found.hashes[np.minimum(first + k, max(last, 0))] * weights[k], np.uint64(0)) if last >= 0 else np.uint64(0)
    return mix(total), bounds


def distinct_shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in row order."""
    for first, last in pieces(column, HASHED_BYTES):
        hashes, bounds = shingles(words(column.slice(first, last - first)), width)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            one = np.sort(hashes[a:b])
            yield one[np.concatenate(([True], one[1:] != one[:-1]))] if b > a else one


def weighed_shingles(column: pa.Array, width: int, weigh) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same, each with the sum of its words' weights (``weigh(hashes)``)."""
    for first, last in pieces(column, HASHED_BYTES):
        found = words(column.slice(first, last - first))
        hashes, bounds = shingles(found, width)
        before = np.concatenate(([0], np.cumsum(weigh(found.hashes))))
        counts = np.diff(bounds)
        owner = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(bounds[-1]) - bounds[owner] + found.bounds[owner]
        weights = before[np.minimum(start + width, found.bounds[owner + 1])] - before[start]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            one, at = np.unique(hashes[a:b], return_index=True)
            yield one, weights[a:b][at]

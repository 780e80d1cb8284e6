"""Packing of token sequences into fixed windows by minimum bin slack.

Each document's ids, closed by an end id, are cut at multiples of the window.
Whole windows stand alone; the remainders of a block of pieces are packed
together.  For each window the longest remaining length is set, and a bitset
subset-sum over the multiset of the other remaining lengths finds the total
closest to the room that is left; the counts are read back from the kept
bitsets.  A found combination is repeated as long as its lengths last.

Blocks are dealt by a hash of the piece, its document and how often the task
has met an equal one, so equal rows spread as others do.  A document leaves one
remainder, so the number of documents, which the files' footers tell, gives
blocks of about ``BLOCK_PIECES`` remainders; whole windows pass through a
block without being held.  Blocks are packed apart, so the only shuffle carries
lengths and digests (and ids where they are wanted) and no task grows with the
data.  Each block leaves at most a few windows short.

Null texts are empty and give one piece holding the end id alone; so do empty
ones.  Repeated rows give a piece each, and pieces of equal length are packed
in the order of doc_id, start and digest.  Texts of any length are taken whole,
a text's ids being held at a time.  An empty table gives no pieces.  Extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import at_rest, encoded
from tidemark.llm.hashing import in_pieces
from tidemark.llm.storage import map_batches

WINDOW = 2048
END_ID = 1
BLOCK_PIECES = 4096

#: Pieces that a task remembers to tell equal ones apart.
REMEMBERED = 200_000

PIECE_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The sub-multiset of lengths with the largest total of at most ``room``."""
    mask = (1 << (room + 1)) - 1
    reached, kept = 1, []
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            kept.append((length, take, reached))
            reached |= reached << (length * take) & mask
            left, take = left - take, take * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for length, take, before in reversed(kept):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def minimum_slack(counts: dict[int, int], window: int) -> Iterator[tuple[dict[int, int], int]]:
    """Window patterns (length -> count) with the times each is used."""
    counts = {k: v for k, v in counts.items() if v}
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        pattern = closest_fill(counts, window - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[k] // v for k, v in pattern.items())
        for k, v in pattern.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        yield pattern, times


def pack_lengths(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence number and offset of each length, and the sequences used."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    values, first, size = np.unique(lengths[order], return_index=True, return_counts=True)
    waiting = {int(v): order[a : a + n].tolist()[::-1] for v, a, n in zip(values, first, size)}
    used = 0
    for pattern, times in minimum_slack({k: len(v) for k, v in waiting.items()}, window):
        for _ in range(times):
            at = 0
            for length in sorted(pattern, reverse=True):
                for _ in range(pattern[length]):
                    row = waiting[length].pop()
                    sequence[row], offset[row] = used, at
                    at += length
            used += 1
    return sequence, offset, used


def cut_documents(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False, blocks: int = 0) -> DataFrame:
    """Pieces of at most ``window`` ids; with ``keep_ids`` also the ids, with
    ``blocks`` also the block that each piece is dealt to (and the ids as bytes,
    which move at less cost)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        for batch in in_pieces(at_rest(batches, path), 1):
            doc, start, length, crc, total, own = [], [], [], [], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), path)):
                ids = np.concatenate((ids, [end_id])).astype("<u4")
                for a in range(0, len(ids), window):
                    piece = ids[a : a + window]
                    doc.append(doc_id)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if keep_ids:
                        own.append(piece.tobytes() if blocks else piece.astype(np.int32))
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns, names = [*columns, pa.array(own, pa.binary() if blocks else pa.list_(pa.int32()))], [*names, "ids"]
            if blocks:
                block = []
                for key in zip(doc, start, crc):
                    block.append(zlib.crc32(b"%r %d" % (key, met[key])) % blocks)
                    met[key] += 1
                if len(met) > REMEMBERED:
                    met.clear()
                columns, names = [*columns, pa.array(block, pa.int64())], [*names, "block"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [", ids binary" if blocks else ", ids array<int>"] if keep_ids else []
    return map_batches(documents.select("doc_id", "text"), run, PIECE_SCHEMA + "".join(kinds) + (", block bigint" if blocks else ""))


def _as_lists(column: pa.Array) -> pa.Array:
    """Lists of ids from their bytes."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4
    values = np.frombuffer(data, np.int32)[ends[0] : ends[-1]] if ends[-1] else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(values))


#: Pieces of a block's remainders that leave a worker at once.
_SENT = 512


def pack_documents(documents: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, block_pieces: int = BLOCK_PIECES, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset; padding follows each sequence's last piece."""
    pieces = cut_documents(documents, path, window, end_id, keep_ids, blocks=max(1, math.ceil(documents.count() / block_pieces)))
    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "") + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block, used = None, 0

        def placed(rows: pa.RecordBatch, sequence: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
            named = {n: c for n, c in zip(rows.schema.names, rows.columns) if n != "block"}
            if keep_ids:
                named["ids"] = _as_lists(named["ids"])
            return pa.RecordBatch.from_pydict({**named, "sequence_id": pa.array(np.int64(block << 32) + sequence), "offset": pa.array(offset)})

        def packed() -> Iterator[pa.RecordBatch]:
            """The block's remainders, which come after its whole windows."""
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                order = pc.sort_indices(rows, [("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
                sequence, offset, _ = pack_lengths(rows["length"].take(order).to_numpy(), window)
                for a in range(0, len(order), _SENT):
                    part = rows.take(order[a : a + _SENT]).combine_chunks().to_batches()[0]
                    yield placed(part, used + sequence[a : a + _SENT], offset[a : a + _SENT])

        for batch in batches:
            blocks, lengths = batch.column(batch.schema.get_field_index("block")).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | ((lengths[1:] == window) != (lengths[:-1] == window))) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if blocks[a] != block:
                    yield from packed()
                    block, used = int(blocks[a]), 0
                part = batch.slice(a, b - a)
                if lengths[a] == window:
                    yield placed(part, used + np.arange(b - a), np.zeros(b - a, np.int64))
                    used += b - a
                else:
                    held.append(part)
        yield from packed()

    dealt = pieces.repartition("block").sortWithinPartitions("block", (F.col("length") < window))
    return map_batches(dealt, run, schema)

"""Document fingerprints by one-permutation MinHash.

The distinct five-word shingles of a text (lower-cased A-Z; fewer words: the
whole sequence) are hashed once.  The top bits of a hash choose one of
``BINS`` bins, which keeps its least hash.  An empty bin takes the value of
the first filled bin in its own fixed random order of all bins, which is
optimal densification.  ``BITS`` low-order bits of each bin are packed into
the fingerprint, hexadecimal.

The share of equal bins is corrected for the chance ``2**-BITS`` that
different values agree, and held within 0 and 1.

A text without words has the empty fingerprint; two of these are alike (1),
one and another text are not (0).  Null texts count as empty.  Documents
follow one another by descending doc_id, equal ones by the hash of the text,
those without doc_id last; the first follows the last.  A table's only
document is its own next; repeated rows follow one another.  Texts of any
length are taken whole.  An empty table gives an empty result.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import PIECE_BYTES, distinct_shingles, mix, pieces
from tidemark.llm.storage import map_batches

BINS = 256
BITS = 4
SHINGLE_WORDS = 5
BUCKET_ROWS = 1024

#: Buckets of neighbours, and sampled keys of 16 bytes for each: what the driver
#: holds and sends is bounded, a bucket is sorted on disk and streamed.
MOST_BUCKETS, SAMPLED = 65_536, 16

_NO_ID = -(2**63)


@lru_cache(maxsize=2)
def _donors(bins: int) -> np.ndarray:
    """Row i: the order in which bin i asks the others for a value."""
    grid = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    return np.argsort(mix(grid * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D)), axis=1, kind="stable")


def bin_minima(hashes: np.ndarray, bins: int = BINS) -> np.ndarray | None:
    """Densified least hash of each bin from sorted distinct hashes."""
    if not len(hashes):
        return None
    shift = np.uint64(64 - int(math.log2(bins)))
    edges = np.searchsorted(hashes, np.arange(bins, dtype=np.uint64) << shift)
    filled = np.diff(np.concatenate((edges, [len(hashes)]))) > 0
    out = hashes[np.minimum(edges, len(hashes) - 1)].copy()
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _donors(bins)[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def pack_bits(values: np.ndarray | None, bits: int = BITS) -> str:
    """Low-order bits of the bins' values, first bin first, in hexadecimal."""
    if values is None:
        return ""
    values = mix(values + np.arange(len(values), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # else one value's copies would agree by chance together
    low = (values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(low.ravel()).tobytes().hex()


def fingerprints(column: pa.Array) -> list[str]:
    return [pack_bits(bin_minima(h)) for h in distinct_shingles(column, SHINGLE_WORDS)]


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity of two texts' shingles."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    apart = np.unpackbits(np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8))
    equal = float((apart.reshape(bins, bits).sum(axis=1) == 0).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (equal - chance) / (1 - chance)))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)), pa.string())], ["doc_id", "fingerprint"])

    return map_batches(documents.select("doc_id", "text"), run, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the next one's start."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


class Cuts:
    """Keys (place, mark) of rows of the table, ascending, the greatest last;
    a bucket holds what lies above one cut up to the next."""

    def __init__(self, places: np.ndarray, marks: np.ndarray) -> None:
        order = np.lexsort((marks, places))
        self.places, self.marks = places[order], marks[order]

    def least_above(self, places: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Index of the least cut at or above each key."""
        low, high = (np.searchsorted(self.places, places, side) for side in ("left", "right"))
        shared = np.flatnonzero(high > low)
        if len(shared):
            order = shared[np.argsort(low[shared], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
                a, b = low[rows[0]], high[rows[0]]
                low[rows] = a + np.searchsorted(self.marks[a:b], marks[rows], "left")
        return low


def _cuts(keys: DataFrame, count: int, bucket_rows: int) -> Cuts:
    """Cuts that deal the keys evenly, from a sample by hash of the distinct ones."""
    wanted = min(max(1, math.ceil(count / bucket_rows)), MOST_BUCKETS)
    top = keys.agg(F.max(F.struct("place", "mark")).alias("top")).first()["top"]
    if top is None:
        return Cuts(np.zeros(0, np.int64), np.zeros(0, np.int64))
    places, marks = np.array([top["place"]], np.int64), np.array([top["mark"]], np.int64)
    if wanted > 1:
        rate = max(1, count // (SAMPLED * wanted))
        few = keys.where(F.pmod(F.xxhash64("place", "mark"), F.lit(rate)) == 0).groupBy("place", "mark").agg(F.count(F.lit(1)).alias("n")).toArrow()
        place, mark, n = (few[c].to_numpy().astype(np.int64) for c in ("place", "mark", "n"))
        order = np.lexsort((mark, place))
        passed = np.cumsum(n[order])
        at = np.flatnonzero(np.diff(passed * wanted // max(1, n.sum()), prepend=0)) if len(order) else order
        keep = order[at]
        keep = keep[(place[keep] != top["place"]) | (mark[keep] != top["mark"])]
        places, marks = np.concatenate((place[keep], places)), np.concatenate((mark[keep], marks))
    return Cuts(places, marks)


def _following(documents: DataFrame, bucket_rows: int) -> DataFrame:
    """Documents dealt to buckets of neighbouring keys, each bucket with the
    row that follows its last one (``extra`` is 1).

    Cuts are keys of rows, so every bucket's first row is known beforehand.
    Rows of a batch that are equal in doc_id and text move as one (``times``).
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("place"), F.xxhash64("text").alias("mark"), "text")
    cuts = _cuts(docs.select("place", "mark"), documents.count(), bucket_rows)
    buckets = len(cuts.places)
    names = ["bucket", "extra", "place", "mark", "times", "doc_id", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, mark, none = batch.column(1).to_numpy(), batch.column(2).to_numpy(), np.asarray(batch.column(0).is_null())
            order = np.lexsort((none, mark, place))
            keys = np.stack((place, mark, none))[:, order]
            first = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if len(order) else order)
            rows, times = order[first], np.diff(np.concatenate((first, [len(order)])))
            place, mark = place[rows], mark[rows]
            cut = cuts.least_above(place, mark)
            head = np.flatnonzero((cuts.places[cut] == place) & (cuts.marks[cut] == mark))
            own = buckets - 1 - cut
            for at, bucket, extra in ((np.arange(len(rows)), own, 0), (head, (own[head] - 1) % buckets, 1)):
                if len(at):
                    part = batch.take(pa.array(rows[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(np.full(len(at), extra, np.int32)), part.column(1), part.column(2), pa.array(times[at].astype(np.int64)), part.column(0), part.column(3)], names)

    return map_batches(docs, deal, "bucket bigint, extra int, place bigint, mark bigint, times bigint, doc_id bigint, text string")


def compare_neighbours(documents: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness.

    The edited text's last third comes from the next document by descending
    doc_id.  Texts move once, to buckets of neighbouring keys.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        """Each document's (doc_id, text, fingerprint) with the one after it, bucket by bucket."""
        now, bucket, over = None, None, False
        own, after = [], []
        for batch in batches:
            for first, last in pieces(batch.column(6)):
                part = batch.slice(first, last - first)
                prints = fingerprints(part.column(6))
                for b, extra, times, doc_id, text, mark in zip(*(part.column(i).to_pylist() for i in (0, 1, 4, 5, 6)), prints):
                    if b != bucket:
                        bucket, now, over = b, None, False
                    document = (doc_id, text, mark)
                    if now is not None and not over:
                        own.append(now)
                        after.append(document)
                    over = over or extra == 1
                    now = document
                    for _ in range(times - 1 if not over else 0):  # equal rows follow one another
                        own.append(document)
                        after.append(document)
                        if len(own) >= 512:
                            yield own, after
                            own, after = [], []
                    if len(own) >= 512 or sum(len(x[1]) for x in own[-1:]) > PIECE_BYTES:
                        yield own, after
                        own, after = [], []
        if own:
            yield own, after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, after in rows(batches):
            texts = [edited(a[1], b[1]) for a, b in zip(own, after)]
            marks = fingerprints(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a in own], pa.int64()),
                    pa.array([len(a[1]) for a in own], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                    pa.array([a[2] for a in own], pa.string()),
                    pa.array(marks, pa.string()),
                    pa.array([likeness(a[2], m) for a, m in zip(own, marks)], pa.float64()),
                    pa.array([likeness(a[2], b[2]) for a, b in zip(own, after)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    placed = _following(documents, bucket_rows).repartition("bucket").sortWithinPartitions("bucket", "extra", F.col("place").desc(), F.col("mark").desc())
    return map_batches(placed, run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

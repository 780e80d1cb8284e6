"""Language identification by rank-order n-gram profiles.

A profile ranks the most frequent one- to three-letter n-grams of a language;
words are lower-cased runs of letters, padded by a boundary mark on either
side.  A document's own most frequent n-grams are ranked the same way, and
each profile's out-of-place distance sums how far every n-gram's rank lies
from its rank in the profile, with the profile's length for one that is not
there.  The nearest profile names the language.

Profiles are fitted on a bounded sample: of each of the ``MOST_LANGUAGES``
most frequent labels about ``sample`` documents, taken by a hash of doc_id at a
rate that follows from the label's count.  Prediction covers every whole text.

Null texts and texts without letters give ``und`` with score 0, as does every
text when no labelled document is there.  Equal n-gram counts are ranked by
the n-gram's number (shorter ones first, then by code points), equal distances
go to the first language by name.  Texts of any length are taken whole.
Repeated rows are predicted alike and learned from as often as they are there.
Documents without doc_id are predicted but never learned from and not held
out.  An empty table gives an empty result.  Extra columns are ignored, but
``keep_identified`` keeps them.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.hashing import pieces
from tidemark.llm.storage import map_batches

PROFILE_GRAMS = 400
SAMPLE_DOCUMENTS = 2000
MOST_LANGUAGES = 1000
UNKNOWN = "und"

#: Letters lie below 2**20; the two bits above three of them tell the n-gram's length.
_BITS = np.int64(20)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for anything else."""
    table = np.zeros(sys.maxunicode + 1, np.int64)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def padded_letters(text: str) -> np.ndarray:
    """Lower-case letters of the text with one 0 around and between words."""
    if not text:
        return np.zeros(1, np.int64)
    low = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    return np.concatenate(([0], low[keep], [0] if low[-1] > 0 else [])).astype(np.int64)


def ngram_codes(letters: np.ndarray) -> np.ndarray:
    """All 1- to 3-grams as numbers; a mark is only ever at an n-gram's end."""
    one = letters[letters > 0]
    a, b = letters[:-1], letters[1:]
    two = (a << _BITS | b)[(a > 0) | (b > 0)]
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    three = ((a << _BITS | b) << _BITS | c)[b > 0]
    return np.concatenate((one, two | np.int64(1) << 60, three | np.int64(1) << 61))


def top_ngrams(codes: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:limit]]


class Profiles:
    """Ranks of every profiled n-gram in every language."""

    def __init__(self, ranked: dict[str, list[int]], limit: int) -> None:
        self.languages, self.limit = sorted(ranked), limit
        self.grams = np.unique(np.array([g for own in ranked.values() for g in own], np.int64))
        self.ranks = np.full((len(self.languages), len(self.grams)), -1, np.int64)
        for row, language in enumerate(self.languages):
            at = np.searchsorted(self.grams, np.array(ranked[language], np.int64))
            self.ranks[row, at] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        letters = padded_letters(text or "")
        if not self.languages or not (letters > 0).any():
            return UNKNOWN, 0.0
        own = top_ngrams(ngram_codes(letters), self.limit)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        there = np.flatnonzero(self.grams[at] == own)
        ranks = self.ranks[:, at[there]]
        away = np.where(ranks < 0, self.limit, np.abs(ranks - there))
        distance = away.sum(axis=1) + (len(own) - len(there)) * self.limit
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (len(own) * self.limit))


def held_out() -> F.Column:
    """Whether crc32 of the doc_id's text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_profiles(documents: DataFrame, limit: int = PROFILE_GRAMS, sample: int = SAMPLE_DOCUMENTS) -> Profiles:
    """Profiles of each language of the labelled documents outside the held-out fold."""
    learn = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).toArrow()
    if not len(sizes):
        return Profiles({}, limit)
    rates = pa.table({"lang": sizes["lang"], "rate": pa.array([max(1, -(-n // sample)) for n in sizes["count"].to_pylist()], pa.int64())})
    rates = F.broadcast(documents.sparkSession.createDataFrame(rates))  # one row a language
    chosen = learn.join(rates, "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("rate")) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch.column(0)):
                by_lang: dict[str, list[np.ndarray]] = {}
                rows = batch.slice(first, last - first).to_pydict()
                for text, lang in zip(rows["text"], rows["lang"]):
                    by_lang.setdefault(lang, []).append(ngram_codes(padded_letters(text or "")))
                for lang, codes in by_lang.items():
                    grams, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = map_batches(chosen.select("text", "lang"), count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    ranked: dict[str, list[int]] = {lang: [] for lang in sizes["lang"].to_pylist()}
    for row in sorted(top.collect(), key=lambda r: r["place"]):
        ranked[row["lang"]].append(row["gram"])
    return Profiles({k: v for k, v in ranked.items() if v}, limit)


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in pieces(batch.column(2)):
                part = batch.slice(first, last - first)
                found = [profiles.predict(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_batches(documents.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents that have a language, missing ``lang`` values filled in.

    Runs beside the rows, so no join is needed; all columns stay.
    """
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, given = batch.column(names.index("text")), batch.column(names.index("lang"))
            for first, last in pieces(texts):
                part = batch.slice(first, last - first)
                found = [profiles.predict(x)[0] for x in texts.slice(first, last - first).to_pylist()]
                lang = pa.array([x or y for x, y in zip(given.slice(first, last - first).to_pylist(), found)], pa.string())
                columns = [lang if n == "lang" else part.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([x != UNKNOWN for x in found]))

    return map_batches(documents, run, documents.schema)

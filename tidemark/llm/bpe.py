"""Byte-level BPE encoding and decoding with batched numpy merge rounds.

The vocabulary file is that of a public byte-level tokenizer in the JSON form
of the ``tokenizers`` library; its path is a parameter.  Texts are cut into
pre-tokens by the vocabulary's fixed pattern.  The distinct pre-tokens that
have no ids yet are encoded together: their symbols lie in one flat array,
each round looks up neighbouring pairs by binary search over the sorted pair
keys, and merges the lowest-ranked pair of every word at once.

Null texts count as empty; empty texts have no ids.  Texts of any length are
taken whole; a pre-token of n bytes takes up to n rounds over what is left of
it, as the lowest-ranked pair of a word merges wherever it occurs.  An empty
table gives an empty result.  Rows are independent, so ties, repeats and extra
columns need no care.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.hashing import pieces
from tidemark.llm.storage import map_batches

#: Pre-tokens remembered by a worker during a task, and after it.  Beyond them
#: the later ones are forgotten: what comes first comes often.
MEMORY_WORDS, REST_WORDS = 180_000, 100_000

_NONE = np.int32(2**31 - 1)

#: Fixed value: the pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[starts[i]:starts[i]+lengths[i]]`` after one another."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]


class _Memory(dict):
    """Pre-token -> index; unknown ones get the next index and are noted."""

    def __init__(self, known=()) -> None:
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = index = len(self)
        self.new.append(word)
        return index


class ByteBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_ids = np.array([vocab[x] for x in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or match whole words only are not supported")
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(PATTERN)
        of_letter = {x: b for b, x in enumerate(letters)}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(of_letter[x] for x in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.memory = _Memory()
        self.flat = np.zeros(0, np.int32)
        self.starts = self.lengths = np.zeros(0, np.int64)

    def forget(self, left: int) -> None:
        """Keep only the first words of the memory."""
        if len(self.memory) <= left:
            return
        self.memory = _Memory(islice(self.memory.items(), left))
        self.starts, self.lengths = self.starts[:left].copy(), self.lengths[:left].copy()
        self.flat = self.flat[: int(self.lengths.sum())].copy()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, or a large number."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbols), _NONE, np.int32)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self.ranks(symbols[same], symbols[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.concatenate((first, [len(symbols)])))
            best = np.minimum.reduceat(rank, first)
            live = np.repeat(best != _NONE, size)
            if not live.all():
                done.append((owner[~live], symbols[~live]))
                owner, symbols, rank = owner[live], symbols[live], rank[live]
                size, best = size[best != _NONE], best[best != _NONE]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, size)
            at = np.flatnonzero(hit)
            # a run of hits is one letter repeated; from its left, every second pair merges
            breaks = np.concatenate(([True], np.diff(at) > 1))
            run = at[breaks][np.cumsum(breaks) - 1]
            at = at[(at - run) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            new_at = (np.cumsum(stay) - 1)[at]
            owner, symbols, rank = owner[stay], symbols[stay], rank[stay]
            fresh = np.concatenate((new_at, new_at[new_at > 0] - 1))
            rank[fresh] = _NONE
            fresh = fresh[fresh + 1 < len(symbols)]
            fresh = fresh[owner[fresh] == owner[fresh + 1]]
            rank[fresh] = self.ranks(symbols[fresh], symbols[fresh + 1])
        if not done:
            return symbols, np.zeros(len(words), np.int64)
        owner = np.concatenate([x for x, _ in done])
        symbols = np.concatenate([x for _, x in done])
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, special tokens' strings included."""
        if len(self.memory) > MEMORY_WORDS:
            self.forget(MEMORY_WORDS // 2)
        memory, find = self.memory, self.pattern.findall
        plans: list[list] = []
        for text in texts:
            plan: list = []
            parts = self.splitter.split(text) if self.splitter and any(t in text for t in self.added) else [text]
            for part in parts:
                if part in self.added:
                    plan.append(self.added[part])
                elif part:
                    found = find(part)
                    plan.append(np.fromiter(map(memory.__getitem__, found), np.int64, len(found)))
            plans.append(plan)
        if memory.new:
            ids, lengths = self.merge([w.encode() for w in memory.new])
            starts = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate((self.flat, ids))
            self.starts, self.lengths = np.concatenate((self.starts, starts)), np.concatenate((self.lengths, lengths))
            memory.new = []
        out = []
        for plan in plans:
            parts = [np.array([x], np.int32) if isinstance(x, int) else gather(self.flat, self.starts[x], self.lengths[x]) for x in plan]
            out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBPE:
    """One codec for each vocabulary and worker process."""
    return ByteBPE(path)


def encoded(column: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Ids of each text of an Arrow column, in row order."""
    own = codec(path)
    for first, last in pieces(column):
        yield from own.encode([x or "" for x in column.slice(first, last - first).to_pylist()])


def at_rest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The batches, after which the worker's memory shrinks."""
    yield from batches
    codec(path).forget(REST_WORDS)


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text decoded from the ids, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in at_rest(batches, path):
            texts = batch.column(1)
            for first, last in pieces(texts):
                ids = own.encode([x or "" for x in texts.slice(first, last - first).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return map_batches(documents.select("doc_id", "text"), run, "doc_id bigint, ids array<int>, decoded string")


def digest_documents(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, one row per document.

    The ids themselves stay in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in at_rest(batches, path):
            counts, of_ids, of_text = [], [], []
            for ids in encoded(batch.column(1), path):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(documents.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

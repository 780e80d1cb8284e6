"""BPE against the tokenizers library, and packing's invariants."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.common import awkward, none
from tidemark.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.no_truncation()
    own.no_padding()
    return own


def test_ids_and_texts(library):
    rng = random.Random(4)
    pool = [chr(c) for c in (*range(600), 0x1C, 0x85, 0xA0, 0x2003, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x301, 0x660, 0x2160, 0x200B, 0x10400)]
    pool += ["'s", "'ll", "<|endoftext|>", "   ", "\n\n", "aaaaaa", "the", " of"] * 12 + [" "] * 60
    texts = ["".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(4000)] + ["", "a" * 3000, "ab" * 2000, " " * 400]
    own = bpe.ByteBPE(PATH)
    ids = own.encode(texts)
    expected = library.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in ids] == [x.ids for x in expected]
    assert [own.decode(x) for x in ids] == [library.decode(x.ids, skip_special_tokens=False) for x in expected]


def test_memory_forgets(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 10)
    own = bpe.ByteBPE(PATH)
    for n in range(20):
        text = f"some words number {n} and {n * n}"
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_invalid_bytes(library):
    ids = library.encode("é", add_special_tokens=False).ids + [int(bpe.codec(PATH).byte_ids[0xC3])]
    assert bpe.codec(PATH).decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_encode_documents(spark, library):
    docs, rows = awkward(spark)
    found = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_documents(docs, PATH).collect())
    assert found == Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in rows)
    assert bpe.digest_documents(none(spark), PATH).count() == 0


def test_closest_fill():
    rng = random.Random(1)
    for _ in range(300):
        lengths = [rng.randrange(1, 15) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(0, 40)
        best = max(sum(c) for n in range(len(lengths) + 1) for c in combinations(lengths, n) if sum(c) <= room)
        chosen, counts = packing.closest_fill(dict(Counter(lengths)), room), Counter(lengths)
        assert sum(k * v for k, v in chosen.items()) == best
        assert all(counts[k] >= v for k, v in chosen.items())


@pytest.mark.parametrize("block_pieces", [2, 4096])
def test_pack(spark, library, block_pieces):
    docs, rows = awkward(spark)
    pieces = packing.pack_documents(docs, PATH, window=64, block_pieces=block_pieces, keep_ids=True).collect()
    expected = [library.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows]
    assert sorted(x for p in pieces for x in p.ids) == sorted(x for ids in expected for x in ids)
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert sum(p.length for p in own) <= 64
    by_doc = {r[0]: ids for r, ids in zip(rows, expected) if r[0] not in (None, 2)}
    for doc_id, ids in by_doc.items():
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [x for p in own for x in p.ids] == ids and {p.doc_tokens for p in own} == {len(ids)}


def test_little_padding(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pieces = packing.pack_documents(docs, PATH).toPandas()
    full = pieces.groupby("sequence_id")["length"].sum()
    assert 1 - full.sum() / (2048 * len(full)) < 0.02
    assert packing.pack_documents(none(spark), PATH).count() == 0

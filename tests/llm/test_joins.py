"""The n-gram Jaccard join, line dedup and the pipeline against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import DOCUMENTS, awkward, key, none, prose
from tidemark.llm import graph, linededup, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_components(rows, width, percent):
    sets = [shingle_set(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), r[0] if not sets[i] else least.get(find(i))) for i, r in enumerate(rows)), key=key)


def variants(count=60):
    rng = random.Random(6)
    out = []
    for k in range(count):
        words = prose(k % 7, 40 + 30 * (k % 3)).split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(["new", "Words", "here"])
        out.append((200 + k, " ".join(words)))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("chunk_sets", [3, 1500])
def test_components(spark, width, percent, chunk_sets):
    docs, rows = awkward(spark, variants())
    found = ngram_join.link_components(docs, width, percent, chunk_sets=chunk_sets)
    assert sorted(map(tuple, found.collect()), key=key) == plain_components(rows, width, percent)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]


def test_components_of_nothing(spark):
    assert ngram_join.link_components(none(spark)).count() == 0
    assert ngram_join.keep_one_of_each(none(spark)).count() == 0


def test_one_of_each(spark):
    docs, rows = awkward(spark, variants())
    kept = ngram_join.keep_one_of_each(docs, 5, 80)
    assert kept.schema == docs.schema
    expected, alone = Counter(), set()
    found = plain_components(rows, 5, 80)
    for doc_id, n, component in found:
        if n == 0:
            expected[doc_id] += 1
        elif doc_id is not None and doc_id == component:
            expected[doc_id] = 1
    alone = {shingle_set(r[1], 5) for r in rows if r[0] is None and r[1]} if (None, 76, None) in found else set()
    expected[None] += len(alone)
    assert Counter(r.doc_id for r in kept.collect()) == expected


def test_common_shingle(spark):
    """One shingle, and one beginning, in every document; two near pairs."""
    rows = [(k, "the same words stand here " + prose(k, 60).replace("\n", " ") + f" end{k}") for k in range(300)]
    rows += [(1000, rows[5][1] + " more"), (1001, "new " + rows[9][1]), (1002, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for chunk_sets in (7, 1500):
        found = ngram_join.link_components(docs, 3, 90, chunk_sets=chunk_sets)
        assert sorted(map(tuple, found.collect()), key=key) == plain_components(rows, 3, 90)


def test_words_of_regular_build(spark):
    """Long words that polynomial hashes confuse are told apart."""
    one, other = "a", "b"
    for _ in range(10):
        one, other = one + other, other + one
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"x {one} y"), (4, f"x {other} y"), (5, one)], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.link_components(docs, 3, 90).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_prefix_tree():
    rng = np.random.default_rng(3)
    from tidemark.llm.hashing import mix

    for _ in range(60):
        bases = [mix(rng.integers(0, 2**62, rng.integers(1, 60)).astype(np.uint64)) for _ in range(4)]
        made = {}
        for _ in range(rng.integers(2, 25)):
            own = bases[rng.integers(4)]
            own = own[rng.permutation(len(own))[: max(1, len(own) - rng.integers(0, 4))]]
            own = np.unique(np.concatenate((own, mix(rng.integers(0, 2**62, rng.integers(0, 4)).astype(np.uint64)))))
            made[own.tobytes()] = own
        sets = list(made.values())
        for sides in (np.zeros(len(sets), int), rng.integers(0, 2, len(sets))):
            if len(sets) < 2:
                continue
            across = (sides != sides[0]).any()
            true = []
            for i in range(len(sets)):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if (not across or sides[i] != sides[j]) and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                        true.append((i, j))
            found = ngram_join.spanning_links(sets, sides, 90)
            assert {tuple(sorted(x)) for x in found} <= {tuple(sorted(x)) for x in true}
            groups = [ngram_join._Groups(len(sets)) for _ in range(2)]
            for own, links in zip(groups, (found, true)):
                for a, b in links:
                    own.join(a, b)
            assert [groups[0].find(i) for i in range(len(sets))] == [groups[1].find(i) for i in range(len(sets))]
            possible = ngram_join.possible_links(np.array([len(s) for s in sets]), [ngram_join.parity_sketch(s) for s in sets], sides, 90)
            assert all(possible[i] for pair in true for i in pair)


def test_graph(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    groups = ngram_join._Groups(200)
    for a, b in edges:
        groups.join(a, b)
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: groups.find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ------------------------------------------------------------------ line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance(spark):
    rng, rows = random.Random(3), []
    for _ in range(1500):
        a = "".join(rng.choices("abé", k=rng.randrange(14)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b"])
        rows.append((a, "".join(b)))
    pairs = spark.createDataFrame(rows, "a string, b string")
    for threshold in (1, 2, 4):
        found = pairs.select("a", "b", linededup.within_edits(linededup.letters_of(F.col("a")), linededup.letters_of(F.col("b")), threshold).alias("near")).collect()
        assert [r.near for r in found] == [edits(r.a, r.b) <= threshold for r in found]


def plain_near(a, b, threshold, least):
    """Whether two lines are near, by the rule of the module's docstring."""
    words = a.split(" "), b.split(" ")
    n = min(map(len, words))
    if n >= 8 and abs(len(words[0]) - len(words[1])) <= 2:
        allowed = 2 if n >= 16 else 1
        if sum((Counter(words[0]) - Counter(words[1])).values()) <= allowed and edits(*words) <= allowed:
            return True
    short = max(map(len, words)) <= 18 and min(len(a), len(b)) >= max(least, (threshold + 1) ** 2)
    return short and abs(len(a) - len(b)) <= threshold and edits(a, b) <= threshold


def plain_dedupe(rows, threshold, least, marks):
    """doc_id and text left of each row; ``marks`` are the hashes of texts."""
    order = []
    for r in rows:
        for number, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            normal = re.sub(r"^ +| +$", "", line).lower()
            if len(normal) >= least and normal.strip(" \t\n\x0b\f\r"):
                order.append(((r[0] if r[0] is not None else 2**63, marks[r[1]], number), normal))
    first = {}
    for place, normal in sorted(order):
        first.setdefault(normal, place)
    near = {a for a in first for b in first if first[b] < first[a] and plain_near(a, b, threshold, least)}
    gone = {(place, normal) for place, normal in order if normal in near or first[normal] != place}
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None))
            continue
        at = r[0] if r[0] is not None else 2**63
        out.append((r[0], "\n".join(x for n, x in enumerate(r[1].split("\n")) if ((at, marks[r[1]], n), re.sub(r"^ +| +$", "", x).lower()) not in gone)))
    return sorted(out, key=key)


def text_marks(docs):
    return {r.text: r.mark for r in docs.select("text", F.xxhash64("text").alias("mark")).collect()}


@pytest.mark.parametrize(("broadcast_bytes", "chunk_lines"), [(0, 2), (24_000_000, 128)])
def test_lines(spark, broadcast_bytes, chunk_lines):
    rng, extra = random.Random(9), []
    pool = [prose(k, 6).replace("\n", "") for k in range(12)]
    for k in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "q", "Z"])
            lines.append("  " * rng.randrange(2) + "".join(line))
        extra.append((300 + k, "\n".join(lines)))
    rows = [(i, t, "en", None, None, 0, "", "", 0, "z") for i, t in [*extra, (1, None), (2, ""), (None, pool[0]), (None, pool[0] + "\nshort"), (3, "short\nshort"), (4, prose(77, 9000)), (4, prose(77, 9000))]]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    found = linededup.dedupe_lines(docs, 2, 12, broadcast_bytes, chunk_lines)
    expected = plain_dedupe([r for r in rows if r[0] != 4], 2, 12, text_marks(docs))
    assert sorted((tuple(r) for r in found.where("doc_id is null or doc_id <> 4").select("doc_id", "text").collect()), key=key) == expected
    assert found.columns == [*docs.columns, "n_lines", "n_equal", "n_near"]
    assert linededup.dedupe_lines(none(spark)).count() == 0


def test_short_lines(spark):
    """Equal lines go at any length but blank ones; too short lines are not near."""
    texts = ["yes\n\n \t\nno\n  chapter one", "YES\n\n \t\nnot\nchapter one\nchapter onX", "x\nyes", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: (r.text, r.n_equal, r.n_near) for r in linededup.dedupe_lines(docs).collect()}
    assert found == {0: (texts[0], 0, 0), 1: ("\n \t\nnot", 2, 1), 2: ("x", 1, 0), 3: ("", 1, 0)}


def test_word_edits(spark):
    """A word of eight, or two of forty, may differ; more may not."""
    base, long = [f"word{k}" for k in range(8)], [f"term{k}" for k in range(40)]

    def swap(words, *at):
        return " ".join("different" if k in at else w for k, w in enumerate(words))

    texts = [swap(base), swap(base, 0), swap(base, 3), swap(base, 7), " ".join(base[:4] + ["more"] + base[4:]), swap(base, 1, 5), " ".join(base[1:])]
    texts += [swap(long), swap(long, 0, 39), swap(long, 3, 4), swap(long, 1, 20, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for chunk_lines in (2, 128):
        found = linededup.dedupe_lines(docs, chunk_lines=chunk_lines).where("n_near = 1 and text = ''").collect()
        assert sorted(r.doc_id for r in found) == [1, 2, 3, 4, 8, 9]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_lines_of_shared_ids(spark, doc_id):
    """Rows without doc_id, or of one, keep their own lines and lose repeats."""
    rows = [(1, "a line that is repeated"), (doc_id, "a line that is repeated\nsame place"), (doc_id, "unique text of its own\nsame place"), (doc_id, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = linededup.dedupe_lines(docs, drop_emptied=True).where(F.col("doc_id").eqNullSafe(F.lit(doc_id))).collect()
    texts = sorted(r.text or "" for r in found)
    assert texts in (["", "same place", "unique text of its own"], ["", "unique text of its own\nsame place"])


def test_removed_by_row(spark):
    """Rows without doc_id or of one doc_id keep what stands nowhere else."""
    rows = [(1, "a text"), (None, "a text"), (None, "b text"), (7, "a text"), (7, "c text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((tuple(r) for r in linededup.dedupe_lines(docs).select("doc_id", "text").collect()), key=key)
    assert found == sorted([(1, "a text"), (None, ""), (None, "b text"), (7, ""), (7, "c text")], key=key)
    assert sorted(r.text for r in linededup.dedupe_lines(docs, drop_emptied=True).collect()) == ["a text", "b text", "c text"]


@pytest.mark.parametrize(("broadcast_bytes", "chunk_lines"), [(0, 3), (24_000_000, 128)])
def test_lines_of_all_lengths(spark, broadcast_bytes, chunk_lines):
    """Lines of 1 to 40 words, changed in words and letters, in rows with
    repeated and missing doc_ids."""
    rng, rows = random.Random(12), []
    pool = [" ".join(prose(k, n).split()[:n]) for k, n in enumerate([1, 2, 5, 7, 8, 9, 14, 15, 16, 17, 18, 19, 20, 24, 40] * 2)]
    for k in range(90):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(pool).split(" ")
            for _ in range(rng.randrange(0, 4) if words else 0):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice([[words[at]], ["new"], [words[at] + "x"], [words[at][:-1]], [words[at] + " " + "more"], [] if len(words) > 1 else ["one"]])
            lines.append(" ".join(words))
        rows.append((rng.choice([None, 5, 6, k + 100]), "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = linededup.dedupe_lines(docs, broadcast_bytes=broadcast_bytes, chunk_lines=chunk_lines)
    assert sorted((tuple(r) for r in found.select("doc_id", "text").collect()), key=key) == plain_dedupe(rows, 2, 1, text_marks(docs))


def test_lookups_lose_nothing(spark):
    """Lines within the threshold always share a lookup key."""
    rng, rows = random.Random(5), []
    for k in range(400):
        a = "".join(rng.choices("abcdefgh ", k=rng.randrange(30, 90)))
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choice(["", "x"])
        rows.append((max(a, "".join(b), key=len), min(a, "".join(b), key=len)))
    lines = spark.createDataFrame([(k, x) for k, r in enumerate(rows) for x in r], "k int, line string")
    made = {(r.k, r.line): r["keys"] for r in lines.select("k", "line", linededup.segment_keys(F.col("line"), 2).alias("keys")).collect()}
    near = 0
    for k, (a, b) in enumerate(rows):
        if edits(a, b) <= 2:
            near += 1
            assert set(made[k, a]) & set(made[k, b][:3])
    assert near > 100


# -------------------------------------------------------------------- pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as own

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    stage = {name: f for name, f in own.STAGES}
    identified = stage["language ID"](spark, docs, data)
    assert identified.columns == names and identified.count() == docs.where(F.rlike("text", F.lit(r"\p{L}"))).count()
    deduped = stage["line dedup"](spark, identified, data)
    assert deduped.columns == names and deduped.where("n_chars <> length(text)").count() == 0
    rows = [tuple(r) for r in deduped.select("doc_id", "text").collect()]
    kept = stage["n-gram Jaccard join"](spark, deduped, data)
    expected = sorted({c if n else i for i, n, c in plain_components(rows, 5, 80)})
    assert sorted(r.doc_id for r in kept.collect()) == expected and kept.columns == names
    clean = stage["PII"](spark, kept, data)
    assert clean.columns == names and clean.count() == kept.count()
    assert clean.where(F.rlike("text", F.lit(r"[a-z]@[a-z0-9]+\.[a-z]"))).count() == 0
    packed = own.run(spark, data)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_pipeline_stages_plainly(spark, data):
    """Line dedup, personal data and packing against plain versions, each on
    what the stage before it kept."""
    import zlib

    import corpus_pipeline as own
    from tests.llm.test_texts import plain_spans
    from tidemark.llm.queries import vocabulary
    from tokenizers import Tokenizer

    stage = {name: f for name, f in own.STAGES}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    identified = stage["language ID"](spark, docs, data).cache()
    rows = [(r.doc_id, r.text) for r in identified.collect()]
    deduped = stage["line dedup"](spark, identified, data).cache()
    emptied = {text for _, text in rows if not text.strip(" \t\n\x0b\f\r")}
    expected = [x for x, before in zip(plain_dedupe(rows, 2, 1, text_marks(identified)), sorted(rows, key=lambda r: r[0])) if x[1].strip(" \t\n\x0b\f\r") or before[1] in emptied]
    assert sorted((r.doc_id, r.text) for r in deduped.collect()) == sorted(expected)
    clean = stage["PII"](spark, deduped, data)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == {r.doc_id for r in deduped.collect()}
    for r in deduped.collect():
        spans = plain_spans(r.text)
        assert all(r.text[a:b] not in texts[r.doc_id] for a, b, _ in spans)
        if not re.search("[0-9@]", r.text):
            assert texts[r.doc_id] == r.text
    library = Tokenizer.from_file(vocabulary())
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    windows = {}
    for p in stage["packing"](spark, clean, data).collect():
        piece = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids == piece and p.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        ids[p.doc_id][p.start : p.start + p.length] = [None] * p.length
    assert all(x is None for own in ids.values() for x in own)
    for own_pieces in windows.values():
        ends = [0, *(a + n for a, n in sorted(own_pieces))]
        assert [a for a, _ in sorted(own_pieces)] == ends[:-1] and ends[-1] <= 2048


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline as own

    for name, docs in (("awkward", awkward(spark)[0]), ("none", none(spark))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        found = own.run(spark, str(tmp_path / name)).collect()
        assert bool(found) == (name == "awkward")

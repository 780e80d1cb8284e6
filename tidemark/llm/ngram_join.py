"""Near-duplicate documents by a prefix-tree join of word n-gram sets.

A document's set holds the distinct hashes of its ``width``-word shingles
(A-Z lower-cased; fewer words: the whole sequence as one).  Two sets link when
``100 * intersection >= percent * union``.  The result names each document's
component of the link graph.

1.  Equal sets form a class; only one of each class goes on.
2.  All shingles have one global order, that of their words' corpus
    frequencies: the sum of the words' logarithms, then the hash.  Words are
    counted over every document in ``2**CELL_BITS`` hash cells, a table of
    fixed size; frequent words stand out from any number of rare ones that
    share a cell.  Sets that link share a shingle among the rarest
    ``n - ceil(percent * n / 100) + 1`` of each, so classes meet under these.
3.  Classes that meet under a shingle belong to the block named by the least
    class there; linking classes share a block.  A block too large for a task
    is dealt into chunks, and every pair of chunks is joined on its own, so a
    task's size is bounded and no pair is lost.
4.  Each class has a parity sketch, one bit for each bucket of shingles, of
    about one bit for each of its shingles.  Differing bits bound the
    symmetric difference from below, so most chance meetings end here and
    only classes with a possible partner in the task send their sets there.
5.  In a task the sets, most frequent shingle of the task first, lie in a
    prefix tree with shared stretches joined into one node.  A set walks down the tree,
    carrying its overlap with the path; a subtree is left when the lengths
    that remain cannot reach the threshold any more, and classes connected
    already are not compared again.
6.  The links found span the components, which star rounds then join.

Texts without words, and null texts, have empty sets and are alone:
component_id is their doc_id.  Documents without doc_id take part; a
component's id is its least doc_id that is not null.  Repeated rows come out
as often as they went in.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.hashing import HASHED_BYTES, distinct_shingles, in_pieces, mix, pieces, weighed_shingles, words
from tidemark.llm.storage import map_batches, materialize, small, unused

CELL_BITS = 20
CHUNK_SETS = 1500
CHUNK_SHINGLES = 1_500_000

_NO_ID = -(2**63)
_ROW_CELLS = 64


def class_of(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    one = mix(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    two = mix(hashes ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes' buckets in 64-bit words; the number of buckets
    is the power of two of at most the set's size, 64 at least."""
    buckets = max(64, 1 << (len(hashes).bit_length() - 1))
    at = (hashes & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def possible_links(sizes: np.ndarray, sketches: list[np.ndarray], sides: np.ndarray, percent: int) -> np.ndarray:
    """Whether each set may link with another one (of the other side, if there
    are two), as far as sizes and sketches tell."""
    order = np.argsort(sizes, kind="stable")
    sizes, sides = sizes[order], sides[order]
    own = [sketches[i] for i in order]
    across = bool((sides != sides[0]).any())
    widths = np.array([len(x) for x in own])
    levels = {int(w): (int(np.searchsorted(widths, w, "left")), int(np.searchsorted(widths, w, "right"))) for w in np.unique(widths)}
    tables = {w: np.stack(own[a:b]) for w, (a, b) in levels.items()}
    found = np.zeros(len(sizes), bool)
    for i in range(len(sizes)):
        last = int(np.searchsorted(sizes * percent, 100 * sizes[i], "right"))
        for width, (a, b) in levels.items():
            first, end = max(a, i + 1), min(b, last)
            if first >= end:
                continue
            rows = tables[width][first - a : end - a]
            while rows.shape[1] > widths[i]:  # buckets fold in halves
                rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
            apart = np.bitwise_count(rows ^ own[i]).sum(axis=1, dtype=np.int64)
            near = (100 + percent) * apart <= (100 - percent) * (sizes[first:end] + sizes[i])
            if across:
                near &= sides[first:end] != sides[i]
            if near.any():
                found[i] = True
                found[first:end] |= near
    out = np.empty(len(found), bool)
    out[order] = found
    return out


def word_weights(documents: DataFrame) -> np.ndarray:
    """A whole number for each hash cell that rises with the logarithm of how
    often words of the cell occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for first, last in pieces(batch.column(0), HASHED_BYTES):
                total += np.bincount(_cells(words(batch.column(0).slice(first, last - first)).hashes), minlength=len(total))
        table = total.reshape(-1, _ROW_CELLS)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in table[used].T)], ["row", *names])

    names = [f"n{k}" for k in range(_ROW_CELLS)]
    counts = map_batches(documents.select("text"), count, "row int, " + ", ".join(f"{n} bigint" for n in names))
    found = counts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((1 << CELL_BITS) // _ROW_CELLS * _ROW_CELLS, np.int64).reshape(-1, _ROW_CELLS)
    out[found["row"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], axis=1)
    return np.round(256 * np.log2(out.ravel() + 1)).astype(np.int32)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _signatures(documents: DataFrame, width: int, percent: int, weights) -> DataFrame:
    """doc_id, a hash of the text, n, c1, c2 (the class), sketch and the rarest shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weigh(hashes: np.ndarray) -> np.ndarray:
            return weights.value[_cells(hashes)].astype(np.int64)

        for batch in in_pieces(batches, 1):
            sizes, one, two, sketch, rare = [], [], [], [], []
            for hashes, often in weighed_shingles(batch.column(1), width, weigh):
                n = len(hashes)
                sizes.append(n)
                a, b = class_of(hashes) if n else (None, None)
                one.append(a)
                two.append(b)
                sketch.append(parity_sketch(hashes).tobytes() if n else None)
                order = np.argsort(often, kind="stable")[: n + percent * n // -100 + 1 if n else 0]
                rare.append(hashes[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketch, pa.binary()), pa.array(rare, pa.list_(pa.int64()))], ["doc_id", "mark", "n", "c1", "c2", "sketch", "rare"])

    return map_batches(documents.select("doc_id", "text", F.xxhash64("text").alias("mark")), run, "doc_id bigint, mark bigint, n bigint, c1 bigint, c2 bigint, sketch binary, rare array<bigint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """c1, c2 and the whole set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 0):
            one, two, sets = [], [], []
            for hashes in distinct_shingles(batch.column(0), width):
                a, b = class_of(hashes)
                one.append(a)
                two.append(b)
                sets.append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["c1", "c2", "shingles"])

    return map_batches(texts.select("text"), run, "c1 bigint, c2 bigint, shingles array<bigint>")


class PrefixTree:
    """Sorted sets as a tree of their common beginnings.

    Sets are lexicographically sorted arrays of ranks; node ``i`` covers the
    sets ``first[i]:last[i]``, whose first ``depth[i]`` ranks agree, and
    ``ends[i]`` is the set that is complete there, or -1.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        self.first: list[int] = []
        self.last: list[int] = []
        self.depth: list[int] = []
        self.least: list[int] = []
        self.most: list[int] = []
        self.ends: list[int] = []
        self.children: list[list[int]] = []
        shared = [self._shared(a, b) for a, b in zip(sets, sets[1:])]
        root = self._node(0, 0)
        stack = [root]
        for i, own in enumerate(sets):
            if i:
                common = shared[i - 1]
                child = -1
                while self.depth[stack[-1]] > common:
                    child = stack.pop()
                    self.last[child] = i
                if self.depth[stack[-1]] < common:
                    parent, middle = stack[-1], self._node(self.first[child], common)
                    self.children[parent][-1] = middle
                    self.children[middle].append(child)
                    stack.append(middle)
            leaf = self._node(i, len(own))
            self.ends[leaf] = i
            self.children[stack[-1]].append(leaf)
            stack.append(leaf)
        for node in stack:
            self.last[node] = len(sets)
        for node in self._upwards():
            below = self.children[node]
            own = [self.depth[node]] if self.ends[node] >= 0 else []
            self.least[node] = min([*own, *(self.least[c] for c in below)])
            self.most[node] = max([*own, *(self.most[c] for c in below)])

    @staticmethod
    def _shared(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        apart = np.flatnonzero(a[:n] != b[:n])
        return int(apart[0]) if len(apart) else n

    def _node(self, first: int, depth: int) -> int:
        for column, value in ((self.first, first), (self.last, first), (self.depth, depth), (self.least, 0), (self.most, 0), (self.ends, -1), (self.children, [])):
            column.append(value)
        return len(self.first) - 1

    def _upwards(self) -> list[int]:
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(self.children[node])
        return order[::-1]

    def matches(self, own: np.ndarray, mask: np.ndarray, percent: int, before: int, skip) -> Iterator[int]:
        """Sets with an index under ``before`` that link with ``own``.

        ``mask`` marks own's ranks; ``skip(i)`` tells that set i need not be
        compared.
        """
        n, both = len(own), 100 + percent
        stack = [(child, 0, 0) for child in self.children[0]]
        while stack:
            node, above, overlap = stack.pop()
            first = self.first[node]
            if first >= before:
                continue
            end, below = self.ends[node], self.children[node]
            if not below and skip(end):
                continue
            # own or the set may lack only so much, whatever is still to come
            if 100 * self.most[node] < percent * n or 100 * n < percent * self.least[node]:
                continue
            depth = self.depth[node]
            path = self.sets[first][above:depth]
            overlap += int(np.count_nonzero(mask[path]))
            if both * (depth - overlap) > 100 * self.most[node] - percent * n:
                continue
            if 0 <= end < before and both * overlap >= percent * (n + depth) and not skip(end):
                yield end
            if not below:
                continue
            passed = int(np.searchsorted(own, path[-1], side="right"))
            if both * (passed - overlap) > 100 * n - percent * self.least[node]:
                continue
            stack.extend((child, depth, overlap) for child in below)


class _Groups:
    """Union-find over positions."""

    def __init__(self, count: int) -> None:
        self.parent, self.count = list(range(count)), count

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.count -= 1


def spanning_links(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the qualifying pairs connect.

    Pairs within a side count when there is one side, else only pairs across
    the two sides (0 and 1) of a pair of chunks.
    """
    flat = np.concatenate(sets)
    known, inverse, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    ranked = [np.sort(x) for x in np.split(rank[inverse], np.cumsum([len(x) for x in sets])[:-1])]
    across = bool((sides != sides[0]).any())
    indexed = [i for i in range(len(sets)) if not across or sides[i] == 0]
    indexed.sort(key=lambda i: ranked[i].astype(">u4").tobytes())
    asking = [i for i in range(len(sets)) if sides[i] == 1] if across else indexed
    tree, groups, links = PrefixTree([ranked[i] for i in indexed]), _Groups(len(sets)), []
    mask = np.zeros(len(known), bool)
    for place, i in enumerate(asking):
        own, before = ranked[i], len(indexed) if across else place
        if across and groups.count == 1:
            break
        mask[own] = True
        for j in tree.matches(own, mask, percent, before, lambda k: groups.find(indexed[k]) == groups.find(i)):
            if groups.find(indexed[j]) != groups.find(i):
                groups.join(i, indexed[j])
                links.append((i, indexed[j]))
                if not across and groups.count == len(sets) - place:
                    break  # all sets so far are connected
        mask[own] = False
    return links


def _by_task(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(task rows as an Arrow table, sides)`` for each task (hub, i, j).

    ``rows`` starts with hub, i, j and chunk; the sides are 0 and 1 for the
    two chunks of a pair.  Tasks whose rows cannot pair are left out.
    """
    keys = ["hub", "i", "j"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            if len(table) < 2:
                return
            i, j, chunk = table["i"][0].as_py(), table["j"][0].as_py(), table["chunk"].to_numpy()
            sides = np.zeros(len(table), np.int64) if i == j else (chunk != i).astype(np.int64)
            if i == j or (sides != sides[0]).any():
                yield from run(table, sides)

        parts, key = [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if tuple(marks[:, a]) != key:
                    if parts:
                        yield from closed(parts)
                    parts, key = [], tuple(marks[:, a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from closed(parts)

    return map_batches(rows.repartition(*keys).sortWithinPartitions(*keys), each, schema)


def _possible(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of each task that have a possible partner there."""

    def run(table: pa.Table, sides: np.ndarray) -> Iterator[pa.RecordBatch]:
        sketches = [np.frombuffer(x, np.uint64) for x in table["sketch"].to_pylist()]
        found = possible_links(table["n"].to_numpy(), sketches, sides, percent)
        if found.any():
            yield from table.select(["hub", "i", "j", "chunk", "c1", "c2"]).filter(pa.array(found)).combine_chunks().to_batches()

    return _by_task(rows.select("hub", "i", "j", "chunk", "c1", "c2", "n", "sketch"), run, "hub bigint, i int, j int, chunk int, c1 bigint, c2 bigint")


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """Links that span each task's components."""

    def run(table: pa.Table, sides: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = [x.values.to_numpy().view(np.uint64) for x in table["shingles"]]
        found = spanning_links(sets, sides, percent)
        if found:
            names = [f"{a & 2**64 - 1:016x}{b & 2**64 - 1:016x}" for a, b in zip(table["c1"].to_pylist(), table["c2"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([names[a] for a, _ in found]), pa.array([names[b] for _, b in found])], ["u", "v"])

    return _by_task(rows.select("hub", "i", "j", "chunk", "c1", "c2", "shingles"), run, "u string, v string")


def _linked(documents: DataFrame, width: int, percent: int, chunk_sets: int = CHUNK_SETS, chunk_shingles: int = CHUNK_SHINGLES) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, hash of the text, set size, component and its least doc_id of
    every document, and the written tables behind them."""
    context = documents.sparkSession.sparkContext
    weights = context.broadcast(word_weights(documents))
    members = materialize(_signatures(documents, width, percent, weights), "signatures")
    # copies lose their arrays before anything is exploded or joined
    alike = members.where("n > 0").groupBy("c1", "c2", "n")
    classes = materialize(alike.agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.first("rare").alias("rare")), "classes")

    # c1 alone names a class until the blocks are known; two classes that share it widen a block
    posts = classes.select("c1", F.explode("rare").alias("shingle"))
    hubs = posts.groupBy("shingle").agg(F.min("c1").alias("hub"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("shingle", "hub")
    blocks = materialize(posts.join(hubs, "shingle").select("hub", "c1").distinct(), "blocks")

    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / chunk_sets), F.ceil(F.sum("n") / chunk_shingles)).cast("int")
    sizes = blocks.join(classes.select("c1", "n"), "c1").groupBy("hub").agg(chunks.alias("chunks")).where("chunks > 1")
    # only blocks of several chunks are looked up, so a large one's classes stay where they are
    dealt = blocks.join(small(sizes), "hub", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.join(classes.select("c1", "c2", "n", "sketch"), "c1")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("c1", "c2"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    possible = materialize(_possible(dealt, percent), "possible", done=[blocks])

    wanted = possible.select("c1", "c2").distinct().join(classes.select("c1", "c2", "least"), ["c1", "c2"])
    wanted = materialize(wanted.select(F.coalesce("least", F.lit(_NO_ID)).alias("id")).distinct(), "wanted")
    texts = documents.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "text").join(small(wanted), "id", "left_semi")
    sets = _sets(texts, width).dropDuplicates(["c1", "c2"])
    links = _links(possible.join(sets, ["c1", "c2"]), percent)

    roots = components(links)
    node = F.concat(F.lpad(F.lower(F.hex("c1")), 16, "0"), F.lpad(F.lower(F.hex("c2")), 16, "0"))
    named = classes.select("c1", "c2", "least", node.alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named.select("c1", "c2", "least", "root"), "roots", done=[classes, possible, wanted])
    found = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("c1", "c2", "root", "component_id")
    out = members.select("doc_id", "mark", "n", "c1", "c2").join(found, ["c1", "c2"], "left")
    found = out.select("doc_id", "mark", "n", "root", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found, [members, named]


def link_components(documents: DataFrame, width: int = 5, percent: int = 80, chunk_sets: int = CHUNK_SETS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    found, _ = _linked(documents, width, percent, chunk_sets, chunk_shingles)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each component, that of the least doc_id
    (then of the least hash of the text).

    Documents without words all stay, as do all columns.
    """
    at, mark = unused(documents, "at", "mark")
    marked = documents.withColumns({at: F.coalesce("doc_id", F.lit(_NO_ID)), mark: F.xxhash64("text")})
    found, behind = _linked(documents, width, percent)
    written = materialize(found.where("n > 0"), "linked", done=behind)
    linked = written.withColumn("at", F.coalesce("doc_id", F.lit(_NO_ID)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "at", "mark")
    first = linked.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("there")).where("there > 1")
    rows = linked.join(first, "root").select(F.col("at").alias(at), F.col("mark").alias(mark), (F.col("first") == place).alias("stays"))
    stays = materialize(rows.groupBy(at, mark).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times")), "stays", done=[written])
    gone, again = stays.where("not stays").select(at, mark), stays.where("stays and times > 1").select(at, mark)
    kept = marked.join(small(gone), [at, mark], "left_anti")
    if again.limit(1).count():  # equal rows of one doc_id
        kept = kept.join(small(again), [at, mark], "left_anti").unionByName(kept.join(small(again), [at, mark], "left_semi").dropDuplicates([at, mark]))
    return kept.select(*documents.columns)

"""Removal of repeated lines by a segment-partition edit join.

Lines are compared trimmed and in lower case; blank ones, and those of fewer
than ``LEAST_CHARS`` code points, are never removed.  Of equal lines the first
by (doc_id, hash of the document's text, line number) stays.  A line that is
near another one that comes first in that order goes as well, with all its
repeats.  Two lines are near

* within ``THRESHOLD`` edits of code points, if both have at least
  (threshold + 1) ** 2 of them, so that each lookup is a substring of the line,
  and at most ``SHORT_WORDS`` words;
* within so many edits of words (parted by single spaces; two spaces in a row
  have an empty word between them) as ``WORD_EDITS`` states for the least
  number of words that both have.

The two overlap: an edit of a code point that makes no new word edits one word.

Near lines are found among the distinct ones.  A line of length l falls into
threshold + 1 even segments, indexed by (l, segment number, segment).  One of
them survives in every line within the threshold, so a line looks up its own
substrings under each length from l - threshold to l, at the starts that
multi-match-aware selection allows.  Candidates are verified by a banded
bit-parallel edit distance: the 2 * threshold + 1 cells of each column around
the diagonal lie in one integer of vertical differences.  Words are searched and
verified alike, as letters of their own, compared by their 64-bit hashes.

Everything is DataFrame expressions.  Texts are split into a written table of
lines once.  Keys are made where a line is read, so lines never move for them;
they are counted in part before they move, and leave before the join if one
distinct line alone holds them; of lines, only candidates move.  Lines that
share a key are compared through lists of at most about ``CHUNK_LINES`` lines,
first by the parities of their letters or words, then by distance, up to the
first earlier line that is near; pairs are never rows, so a key that many lines
share makes rows in proportion to the lines and the lists, dealt by (key,
list).  Tables are broadcast when their rows, counted and of fixed width, take
at most ``BROADCAST_BYTES``, and shuffled else, to the same result.

Null texts stay null.  Documents without doc_id come last in the order.
Rows of equal doc_id, or without one, are told apart by the hash of their
texts; of rows equal in both, lines of one number all stay or all go.  Texts
of any length are taken whole, at a cost in proportion to it.  An empty table
gives an empty result.  All columns stay.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import BROADCAST_BYTES, fits, materialize, small, unused

THRESHOLD = 2
LEAST_CHARS = 1
CHUNK_LINES = 128

#: Word edits, and the words that both lines have at least for so many.
WORD_EDITS = ((1, 8), (2, 16))

#: Words of a line that is compared by its code points, at most.
SHORT_WORDS = 18

_WHITE = " \t\n\x0b\f\r"

_LAST = 2**63 - 1


def lookups(threshold: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift of its start) of every lookup, the
    line's own segments first."""
    found = []
    for less in range(threshold + 1):
        for number in range(threshold + 1):
            low = max(-number, less - (threshold - number))
            high = min(number, less + (threshold - number))
            found += [(less, number, shift) for shift in range(low, high + 1)]
    return sorted(found, key=lambda x: (x[0] or abs(x[2]) > 0, x))


def _part(n: Column, edits, less, number, shift) -> tuple[Column, Column]:
    """Start (from 1) and width of the part that a lookup takes of something
    of length ``n``: segment ``number`` of a length that is ``less`` shorter."""
    count = edits + 1
    size = F.call_function("div", n - less, count).cast("int")
    larger = count - F.pmod(n - less, count)
    return size * number + F.greatest(number - larger, F.lit(0)) + (shift + 1), F.when(larger <= number, size + 1).otherwise(size)


def segment_keys(line: Column, threshold: int) -> Column:
    """Array of the keys of a line's code points, the first threshold + 1 of
    which are its index keys.

    Lines must have at least ``(threshold + 1) ** 2`` code points, so that no
    lookup leaves the line.
    """
    n, keys = F.length(line), []
    for less, number, shift in lookups(threshold):
        start, width = _part(n, F.lit(threshold), *map(F.lit, (less, number, shift)))
        keys.append(F.xxhash64(F.lit(number), n - less, line.substr(start, width)))
    return F.array(*keys)


def _name(k1: Column) -> Column:
    """A hash without its lowest bit, which marks lookups."""
    return k1.bitwiseAND(F.lit(-2))


def _bands() -> list[tuple[int, int, int]]:
    """Word edits with the least and the most words of lines that look up keys
    for them: lines that are long enough for more edits need no keys of fewer,
    but for partners that are not."""
    ends = [least + edits - 1 for (edits, _), (_, least) in zip(WORD_EDITS, WORD_EDITS[1:])]
    return [(edits, least, most) for (edits, least), most in zip(WORD_EDITS, [*ends, 2**31 - 1])]


def _word_range(line: Column, n: Column, start: Column, width: Column) -> Column:
    """Words ``start`` (from 1) to ``start + width - 1`` of a line of ``n``,
    looked for from the nearer end."""

    def first(x: Column, count: Column) -> Column:
        return F.call_function("substring_index", x, F.lit(" "), count)

    end = start + width - 1
    forwards = F.when(start > 1, first(first(line, end), -width)).otherwise(first(line, end))
    backwards = F.when(end < n, first(first(line, -(n - start + 1)), width)).otherwise(first(line, -width))
    return F.when(start <= n - end, forwards).otherwise(backwards)


def line_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """key and post of every line's lookups, for every kind of edits that it is
    long enough for; a post is the line's name, its lowest bit 0 for index keys."""

    def specs(words: int) -> list[Column]:
        """Lookups of a line of so many words."""
        kinds = [(True, threshold)] if words <= SHORT_WORDS else []
        kinds += [(False, edits) for edits, least, most in _bands() if least <= words <= most]
        found = [(letters, edits, *x, int(at > edits)) for letters, edits in kinds for at, x in enumerate(lookups(edits))]
        return [F.struct(*[F.lit(v).alias(k) for k, v in zip(("letters", "edits", "less", "number", "shift", "bit"), x)]) for x in found]

    cuts = sorted({SHORT_WORDS + 1, *(x for _, least, most in _bands() for x in (least, most + 1) if x < 2**31)})
    asked = F.array(*specs(cuts[-1]))  # literals, chosen by the number of words
    for cut in reversed(cuts):
        asked = F.when(F.col("n_words") < cut, F.array(*specs(cut - 1))).otherwise(asked)
    posed = lines.select("k1", "line", "n_words", F.explode(asked).alias("s")).select("k1", "line", "n_words", "s.*")
    posed = posed.withColumn("size", F.when(F.col("letters"), F.length("line")).otherwise(F.col("n_words"))).where(~F.col("letters") | (F.col("size") >= (threshold + 1) ** 2))
    start, width = _part(F.col("size"), *map(F.col, ("edits", "less", "number", "shift")))
    posed = posed.withColumns({"start": start, "width": width})
    part = F.when(F.col("letters"), F.col("line").substr(F.col("start"), F.col("width"))).otherwise(_word_range(F.col("line"), F.col("size"), F.col("start"), F.col("width")))
    key = F.xxhash64("edits", "number", F.col("size") - F.col("less"), part)
    return posed.select(_name(key).alias("key"), _name(F.col("k1")).bitwiseOR(F.col("bit").cast("bigint")).alias("post"))


def within_edits(left: Column, right: Column, threshold: int) -> Column:
    """Whether two arrays are within ``threshold`` edits (at most 30).

    Column j of the distance table is held for the rows j - threshold to
    j + threshold; bit k stands for row j - threshold + k.  ``up`` and ``down``
    mark rows that are one more or one less than the row above, already moved
    to the next column's window.  The distance follows the window's lower edge
    down the diagonal and, once that has passed the last row, the last row.
    Equal beginnings and ends are left out first.
    """
    bits = 2 * threshold + 1
    full = (1 << bits) - 1

    def long(x: int) -> Column:
        return F.lit(x).cast("bigint")

    def let(value: Column, use) -> Column:
        """``use`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def distance(rows: Column, columns: Column) -> Column:
        height, width = F.size(rows), F.size(columns)

        def equal_rows(j: Column) -> Column:
            def marks(letter: Column) -> Column:
                total = long(0)
                for k in range(bits):
                    total = total.bitwiseOR(F.when(F.get(rows, j - 1 - threshold + k) == letter, long(1 << k)).otherwise(long(0)))
                return total

            return let(F.get(columns, j - 1), marks)

        def step(state: Column, j: Column) -> Column:
            up, down = state["up"], state["down"]

            def diagonal(equal: Column) -> Column:
                return (equal.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(equal).bitwiseOR(down).bitwiseAND(long(full))

            def sides(same: Column) -> Column:
                more = down.bitwiseOR(F.bitwise_not(same.bitwiseOR(up))).bitwiseAND(long(full))
                return F.struct(same.alias("same"), more.alias("more"), same.bitwiseAND(up).alias("less"))

            def close(x: Column) -> Column:
                moved, place = F.shiftright(x["same"], 1), height - j + threshold
                edge = long(1) - F.shiftright(x["same"], 2 * threshold).bitwiseAND(long(1))
                along = F.call_function("shiftright", x["more"], place).bitwiseAND(long(1)) - F.call_function("shiftright", x["less"], place).bitwiseAND(long(1))
                return F.struct(
                    x["less"].bitwiseOR(F.bitwise_not(moved.bitwiseOR(x["more"]))).bitwiseAND(long(full)).alias("up"),
                    moved.bitwiseAND(x["more"]).alias("down"),
                    (state["distance"] + F.when(j + threshold <= height, edge).otherwise(along)).alias("distance"),
                )

            # diagonals never fall, and the band is 2 * threshold wide
            return F.when(state["distance"] > 3 * threshold, state).otherwise(let(equal_rows(j), lambda e: let(diagonal(e), lambda d: let(sides(d), close))))

        start = F.struct(long(full ^ ((1 << threshold) - 1)).alias("up"), long(0).alias("down"), F.least(height, F.lit(threshold)).cast("bigint").alias("distance"))
        places = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step)["distance"]

    def agree(x: Column, y: Column) -> Column:
        """How many first items are equal."""
        differs = F.array_position(F.zip_with(x, y, lambda a, b: a == b), F.lit(False))
        return let(differs, lambda at: F.when(at > 0, at - 1).otherwise(F.least(F.size(x), F.size(y)))).cast("int")

    def cut_front(x: Column, y: Column, use) -> Column:
        def without(n: Column) -> Column:
            return let(F.slice(x, n + 1, F.size(x) - n), lambda a: let(F.slice(y, n + 1, F.size(y) - n), lambda b: use(a, b)))

        return let(agree(x, y), without)

    def turned(x: Column, y: Column) -> Column:
        return let(F.reverse(x), lambda a: let(F.reverse(y), lambda b: cut_front(a, b, distance)))

    found = let(left, lambda rows: let(right, lambda columns: cut_front(rows, columns, turned)))
    return F.when(F.abs(F.size(left) - F.size(right)) <= threshold, found <= threshold).otherwise(F.lit(False))


def letters_of(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(_WHITE)) == ""


def split_lines(documents: DataFrame, least_chars: int) -> DataFrame:
    """place (doc_id, row and number), normal form, its number of words and its
    two hashes of each line."""
    named = documents.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("row"), F.split("text", "\n").alias("lines"))
    split = named.select("doc", "row", F.posexplode("lines").alias("number", "line"))
    normal = split.select(F.struct("doc", "row", "number").alias("place"), F.lower(F.trim("line")).alias("line")).where(~_blank(F.col("line")))
    if least_chars > 1:
        normal = normal.where(F.length("line") >= least_chars)
    spaces = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    return normal.select("place", "line", (spaces + 1).alias("n_words"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


#: Letters whose parities make a line's signature; an edit changes two at most.
_SIGNED = "abcdefghijklmnopqrstuvwxyz "


def signature(line: Column) -> Column:
    """Parities of the counts of some letters as bits of a long."""
    total = F.lit(0).cast("bigint")
    for place, letter in enumerate(_SIGNED):
        odd = (F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))).cast("bigint").bitwiseAND(F.lit(1))
        total = total.bitwiseOR(F.shiftleft(odd, place))
    return total


def word_signature(words: Column) -> Column:
    """Parities of the counts of words' hashes; an edit changes two at most."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda s, w: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(w, F.lit(64)).cast("int"))))


def _against_chunks(rows: DataFrame, entry: list[str], met, chunk_lines: int, broadcast_bytes: int) -> DataFrame:
    """``rows`` (key, ...) for which ``met(row, other)`` holds for any other
    row of their key, with columns ``entry`` of the others at hand.

    A key's rows are dealt into chunks of about ``chunk_lines``; each row goes
    through every chunk's list, so a list's size is bounded and a pair is
    never a row of its own.
    """
    large = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk_lines).cast("int").alias("chunks")).where("chunks > 1")
    dealt = rows.join(small(large, broadcast_bytes), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("k1", "k2"), F.col("chunks")).cast("int"))
    lists = dealt.groupBy("key", "chunk").agg(F.collect_list(F.struct(*entry)).alias("others"))
    asking = dealt.drop("chunk").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return asking.join(lists, ["key", "chunk"]).where(F.exists("others", met)).drop("others", "chunk", "chunks")


def _once(lines: DataFrame, classes: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``lines`` without repeats, as far as the classes of more than one line
    can be broadcast; repeats that stay make keys that count once all the same."""
    often = classes.where("n > 1").select("k1", "k2", "first")
    if not fits(often, broadcast_bytes):
        return lines
    return lines.join(F.broadcast(often), ["k1", "k2"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("place"))).drop("first")


def near_lines(lines: DataFrame, often: DataFrame, threshold: int, broadcast_bytes: int, chunk_lines: int) -> DataFrame:
    """k1 and k2 of the distinct lines that have an earlier near line.

    ``often`` has k1, k2 and the first place of each line that is there more
    than once.  Keys of repeats are left out as far as it can be broadcast;
    those that stay count once all the same.
    """

    def once(rows: DataFrame) -> DataFrame:
        """The first of equal lines."""
        return rows.join(small(often, broadcast_bytes), ["k1", "k2"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("place"))).drop("first")

    distinct = once(lines) if fits(often, broadcast_bytes) else lines
    posts = materialize(line_keys(distinct, threshold), "line-keys")
    shared = posts.groupBy("key").agg(F.min("post").alias("low"), F.max("post").alias("high"))
    shared = materialize(shared.where(_name(F.col("low")) != _name(F.col("high"))).select("key"), "line-shared")
    met = posts.join(small(shared, broadcast_bytes), "key").groupBy("key", _name(F.col("post")).alias("name"))
    posts = materialize(met.agg((F.min(F.col("post").bitwiseAND(F.lit(1))) == 0).alias("indexed")), "line-posts", done=[posts, shared])

    wanted = materialize(posts.select("name").distinct(), "line-names")
    texts = once(lines.withColumn("name", _name(F.col("k1"))).join(small(wanted, broadcast_bytes), "name", "left_semi"))
    texts = texts.dropDuplicates(["k1", "k2"])  # equal rows of a document have equal places
    texts = texts.withColumn("words", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)))
    texts = texts.withColumns({"word_signature": word_signature(F.col("words")), "n_chars": F.length("line"), "line": F.when(F.col("n_words") <= SHORT_WORDS, F.col("line"))})
    texts = materialize(texts.withColumn("signature", signature(F.col("line"))), "line-texts", done=[wanted])
    entry = ["place", "signature", "word_signature", "n_words", "n_chars", "indexed"]

    def chars_alike(y: Column) -> Column:
        apart = F.bit_count(F.col("signature").bitwiseXOR(y["signature"]))
        short = F.greatest("n_words", y["n_words"]) <= SHORT_WORDS
        return short & (F.least("n_chars", y["n_chars"]) >= (threshold + 1) ** 2) & (F.abs(F.col("n_chars") - y["n_chars"]) <= threshold) & F.coalesce(apart <= 2 * threshold, F.lit(False))

    def words_alike(y: Column, edits: int, least: int, below: int) -> Column:
        words = F.least("n_words", y["n_words"])
        apart = F.bit_count(F.col("word_signature").bitwiseXOR(y["word_signature"]))
        return (words >= least) & (words < below) & (F.abs(F.col("n_words") - y["n_words"]) <= edits) & (apart <= 2 * edits)

    # a pair that is long enough for more edits needs no test of fewer
    by_words = [(edits, least, below) for (edits, least), below in zip(WORD_EDITS, [*(x for _, x in WORD_EDITS[1:]), 2**31 - 1])]

    def alike(y: Column) -> Column:
        kinds = [chars_alike(y), *[words_alike(y, *kind) for kind in by_words]]
        return (F.col("indexed") | y["indexed"]) & (F.col("place") != y["place"]) & reduce(or_, kinds)

    met = posts.join(texts.drop("line", "words"), "name")
    met = _against_chunks(met, entry, alike, chunk_lines, broadcast_bytes).select("key", "name", "k1", "k2", "indexed").distinct()
    meetings = materialize(met, "line-meetings", done=[posts])
    met = meetings.join(texts, ["name", "k1", "k2"])

    def earlier(y: Column) -> Column:
        kinds = [chars_alike(y) & within_edits(letters_of(F.col("line")), letters_of(y["line"]), threshold)]
        kinds += [words_alike(y, *kind) & within_edits(F.col("words"), y["words"], kind[0]) for kind in by_words]
        return (F.col("indexed") | y["indexed"]) & (y["place"] < F.col("place")) & reduce(or_, kinds)

    found = _against_chunks(met, [*entry, "line", "words"], earlier, chunk_lines, broadcast_bytes)
    return materialize(found.select("k1", "k2").distinct(), "line-near", done=[texts, meetings])


def repeated_lines(documents: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, broadcast_bytes: int = BROADCAST_BYTES, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """doc, row (hash of the text), number and whether it is near (else equal) of
    every line to be removed."""
    lines = materialize(split_lines(documents, least_chars), "lines")
    often = materialize(lines.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"), "line-repeats")
    first = lines.select("k1", "k2", "place").join(small(often, broadcast_bytes), ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("place").alias("first"))
    often = materialize(first, "line-firsts", done=[often])
    near = near_lines(lines, often, threshold, broadcast_bytes, chunk_lines)
    marked = often.join(near.withColumn("near", F.lit(True)), ["k1", "k2"], "full")
    marked = materialize(marked.select("k1", "k2", "first", F.coalesce("near", F.lit(False)).alias("near")), "line-marks", done=[often, near])
    found = lines.select("k1", "k2", "place").join(small(marked, broadcast_bytes), ["k1", "k2"]).where("near or place <> first")
    return materialize(found.select("place.doc", "place.row", "place.number", "near").distinct(), "line-found", done=[lines, marked])


def dedupe_lines(documents: DataFrame, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, broadcast_bytes: int = BROADCAST_BYTES, chunk_lines: int = CHUNK_LINES, drop_emptied: bool = False) -> DataFrame:
    """The documents without their repeated lines, with n_lines, n_equal and
    n_near (lines there were, and lines removed of either kind), which take
    the place of columns of these names.

    With ``drop_emptied``, documents that lose all lines but blank ones go,
    and the columns are the documents' own.
    """
    found = repeated_lines(documents, threshold, least_chars, broadcast_bytes, chunk_lines)
    doc, row, gone, equal, near = unused(documents, "doc", "row", "gone", "equal", "near")
    by_doc = found.groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.collect_set("number").alias(gone), F.sum((~F.col("near")).cast("bigint")).alias(equal), F.sum(F.col("near").cast("bigint")).alias(near))
    by_doc = materialize(by_doc, "line-gone")
    # texts are shuffled whatever the size of what goes, so the cost follows the input
    placed = documents.withColumns({doc: F.coalesce("doc_id", F.lit(_LAST)), row: F.xxhash64("text")})
    joined = placed.join(by_doc.hint("shuffle_hash"), [doc, row], "left")
    lines = F.split("text", "\n")
    # what stays is found by a hash of what goes, so a long text's lines cost no more each
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.get(F.transform(F.array(lines), lambda own: F.array_join(F.transform(stays, lambda i: F.get(own, i)), "\n")), F.lit(0))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    if drop_emptied:
        joined = joined.where(F.col(gone).isNull() | ~F.coalesce(_blank(kept), F.lit(False)))
        return joined.select(*[kept.alias(c) if c == "text" else F.col(c) for c in documents.columns])
    counts = {"n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("bigint"), "n_equal": F.coalesce(equal, F.lit(0)), "n_near": F.coalesce(near, F.lit(0))}
    return joined.select(*[kept.alias(c) if c == "text" else F.col(c) for c in documents.columns if c not in counts], *[v.alias(k) for k, v in counts.items()])

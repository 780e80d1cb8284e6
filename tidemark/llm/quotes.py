"""Conversations without quotes, in reply order.

Lines that start with ``>`` marks, which may be spaced, are quotes; the number
of marks is their level.  Stretches of quoted lines of one level and stretches
of the author's own lines, parted by blank lines, are passages.  A passage in
normal form (lower case, white space collapsed) has a hash, by which quoted
passages are joined with the messages that wrote them: the first message of
the same conversation that has the passage among its own, if it comes before
the quote, else the first message of any other conversation.

A message answers the message it quotes at the lowest level (of several the
latest), and without a quote of its own conversation the message before it.
Messages are ordered by the message they answer, then by turn: what a message
answers always stands before it, and answers to one message stand together.
Quoted lines, and then blank lines around the text, are taken out.

Hashes are counted down to their first writers (one, and one of another
conversation) before they meet the quotes; these are broadcast while their
rows take few bytes, else the quotes of a passage are dealt over several
tasks.  Order within a conversation is found in blocks of ``BLOCK_TURNS``
turns of one answered message, then over the blocks of ``BLOCK_TURNS``
answered messages, then over the conversation, and nothing is paired within a
group, so a passage, a first turn or a conversation that holds much of the
table costs no single task more than its blocks.

Messages without conv_id or turn keep their text clean, but answer nothing,
are answered by nothing and have no position.  Null and empty texts have no
passages; texts of any length are taken whole, at a cost in proportion to
their lines.  The code points U+FDD0 and U+FDD1, which are no characters, do
not count in passages.  Repeated rows stay; equal turns of a conversation
share their parent and take positions by role, clean text and text with its
quotes, nulls first, and wholly equal ones share a position.  An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.storage import fits, materialize, met

BLOCK_TURNS = 4096

_MARKS = r"^(?:[ \t]*>)+"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Part passages from one another, and a passage's level from its text.
_BREAK, _LEVEL = "\ufdd0", "\ufdd1"


def passages(text: Column) -> Column:
    """Array of (level, body) in normal form; the author's own are level 0."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), _BREAK + _LEVEL, ""), r"\r?\n")

    def parsed(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        body = F.trim(F.regexp_replace(F.lower(line.substr(F.length(marks) + 1, F.length(line))), r"\s+", " "))
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"), body.alias("body"))

    def marked(own: Column) -> Column:
        """Each line after a space, or after a break and its level where a passage begins."""

        def one(x: Column, i: Column) -> Column:
            before = F.get(own, i - 1)
            goes_on = (i > 0) & (before["body"] != "") & (before["level"] == x["level"])
            fresh = F.concat(F.lit(_BREAK), x["level"].cast("string"), F.lit(_LEVEL), x["body"])
            return F.when(x["body"] == "", F.lit("")).when(goes_on, F.concat(F.lit(" "), x["body"])).otherwise(fresh)

        return F.array_join(F.transform(own, one), "")

    found = F.filter(F.split(_let(F.transform(lines, parsed), marked), _BREAK), lambda x: x != "")
    return F.transform(found, lambda x: F.struct(F.substring_index(x, _LEVEL, 1).cast("int").alias("level"), F.substring_index(x, _LEVEL, -1).alias("body")))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and blank lines around what is left."""
    own = F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(_MARKS)))
    return F.when(F.contains(text, F.lit(">")), F.regexp_replace(F.array_join(own, "\n"), r"^(?:[ \t\r]*\n)+|\s+$", "")).otherwise(text)


def _digest(body: Column) -> list[Column]:
    """128 bits in two columns of fixed width."""
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2")]


_HASH = ["h1", "h2"]


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, text_hash, level, origin_conv and origin_turn of each
    quoted passage; the origin is null if no message wrote it."""
    known = messages.where("conv_id is not null and turn is not null")
    parsed = known.select("conv_id", "turn", F.xxhash64("text").alias("text_hash"), F.explode(passages(F.col("text"))).alias("p"))
    parsed = materialize(parsed.select("conv_id", "turn", "text_hash", F.col("p.level").alias("level"), *_digest(F.col("p.body"))), "passages")
    quotes = materialize(parsed.where("level > 0").distinct(), "quotes")
    wanted = materialize(quotes.select(*_HASH).distinct(), "quoted")
    written = parsed.where("level = 0").select("conv_id", "turn", *_HASH)
    here = met(written, wanted.withColumn("asked", F.lit(True)), _HASH, fits(wanted)).groupBy(*_HASH, "conv_id").agg(F.min("turn").alias("turn"))
    here = materialize(here, "written", done=[wanted, parsed])
    writer = F.struct("conv_id", "turn")
    first = materialize(here.groupBy(*_HASH).agg(F.min(writer).alias("first")), "first-writers")
    few = fits(first)
    others = met(here, first, _HASH, few).where(F.col("conv_id") != F.col("first.conv_id")).groupBy(*_HASH).agg(F.min(writer).alias("second"))
    anywhere = materialize(first.join(others, _HASH, "left"), "writers", done=[first])
    found = quotes.join(here.withColumnRenamed("turn", "own"), [*_HASH, "conv_id"], "left")
    found = met(found, anywhere, _HASH, few, "left")
    inside = F.col("own") < F.col("turn")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    found = found.withColumn("origin", F.when(inside, F.struct("conv_id", F.col("own").alias("turn"))).otherwise(other))
    return materialize(found.select("conv_id", "turn", "text_hash", "level", F.col("origin.conv_id").alias("origin_conv"), F.col("origin.turn").alias("origin_turn")), "links", done=[quotes, here, anywhere])


def _previous_turns(messages: DataFrame, block_turns: int) -> DataFrame:
    """conv_id, turn and the turn before it, once for each turn there is."""
    turns = messages.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).select("conv_id", "turn", F.floor(F.col("turn") / block_turns).alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    blocks = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    blocks = blocks.select("conv_id", "block", F.lag("last").over(Window.partitionBy("conv_id").orderBy("block")).alias("before"))
    return turns.withColumn("near", F.lag("turn").over(inside)).join(blocks, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("near", "before").alias("previous"))


def _positions(messages: DataFrame, block_turns: int) -> DataFrame:
    """``messages`` with position: the rank by (parent, turn, role, text, text with its quotes) in each conversation."""
    parent = F.coalesce("parent_turn", F.lit(-(2**63)))
    blocked = messages.withColumns({"parent": parent, "many": F.floor(F.coalesce("parent_turn", F.lit(-1)) / block_turns), "block": F.floor(F.col("turn") / block_turns)})
    blocked = blocked.withColumn("many", F.when(F.col("parent_turn").isNull(), F.lit(-(2**63))).otherwise(F.col("many")))
    counts = blocked.groupBy("conv_id", "many", "parent", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    near = Window.partitionBy("conv_id", "many").orderBy("parent", "block").rowsBetween(*earlier)
    far = Window.partitionBy("conv_id").orderBy("many").rowsBetween(*earlier)
    wholes = counts.groupBy("conv_id", "many").agg(F.sum("n").alias("n")).select("conv_id", "many", F.coalesce(F.sum("n").over(far), F.lit(0)).alias("far"))
    counts = counts.select("conv_id", "many", "parent", "block", F.coalesce(F.sum("n").over(near), F.lit(0)).alias("near")).join(wholes, ["conv_id", "many"])
    inside = Window.partitionBy("conv_id", "many", "parent", "block").orderBy("turn", "role", "text", "quoting")
    placed = blocked.withColumn("place", F.rank().over(inside)).join(counts, ["conv_id", "many", "parent", "block"])
    return placed.withColumn("position", F.col("far") + F.col("near") + F.col("place")).drop("many", "parent", "block", "far", "near", "place")


def quoting(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of messages made to quote by a rule: of
    three turns one stays, one quotes the turn before it, and one that turn and,
    a level deeper, the one before."""
    own = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    texts = own.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))

    def before(turns: int, name: str) -> DataFrame:
        return texts.select("conv_id", (F.col("turn") + turns).alias("turn"), F.col("said").alias(name))

    def marked(name: str, marks: str) -> Column:
        return F.concat(F.lit(marks), F.replace(F.col(name), F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))

    both = own.join(before(1, "last"), ["conv_id", "turn"], "left").join(before(2, "older"), ["conv_id", "turn"], "left")
    deep = F.when((kind == 2) & F.col("older").isNotNull(), marked("older", "> > ")).otherwise(F.lit(""))
    text = F.when((kind > 0) & F.col("last").isNotNull() & F.col("text").isNotNull(), F.concat(deep, marked("last", "> "), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return both.select("conv_id", "turn", "role", text.alias("text"))


def thread_conversations(messages: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, turn, role, clean text, quotes found and linked, the message
    answered (parent_turn) and the position in reply order of every message.

    origin_conv and origin_turn name the message of another conversation that
    was quoted at the lowest level, if the own one has none.
    """
    own = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text", F.xxhash64("text").alias("text_hash"))
    links = quote_links(own)
    same = F.col("origin_conv") == F.col("conv_id")
    found = links.groupBy("conv_id", "turn", "text_hash").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("origin_turn").alias("n_linked"),
        F.min(F.when(same, F.struct("level", (-F.col("origin_turn")).alias("t")))).alias("here"),
        F.min(F.when(~same, F.struct("level", "origin_conv", "origin_turn"))).alias("there"),
    )
    clean = unquoted(F.col("text"))
    clean = own.select("conv_id", "turn", "role", clean.alias("text"), "text_hash", F.when(clean != F.col("text"), F.col("text")).alias("quoting"))
    known = clean.where("conv_id is not null and turn is not null")
    threaded = known.join(found, ["conv_id", "turn", "text_hash"], "left").join(_previous_turns(known, block_turns), ["conv_id", "turn"])
    threaded = threaded.withColumn("parent_turn", F.coalesce(-F.col("here.t"), "previous"))
    columns = ["conv_id", "turn", "role", "text", "parent_turn", "origin_conv", "origin_turn", "n_quotes", "n_linked", "position"]
    placed = _positions(threaded, block_turns).withColumns({
        "n_quotes": F.coalesce("n_quotes", F.lit(0)), "n_linked": F.coalesce("n_linked", F.lit(0)),
        "origin_conv": F.when(F.col("here").isNull(), F.col("there.origin_conv")), "origin_turn": F.when(F.col("here").isNull(), F.col("there.origin_turn")),
    })
    empty = F.lit(None).cast("bigint")
    stray = clean.where("conv_id is null or turn is null").select("conv_id", "turn", "role", "text", *(empty.alias(c) for c in columns[4:7]), F.lit(0).cast("bigint").alias("n_quotes"), F.lit(0).cast("bigint").alias("n_linked"), empty.alias("position"))
    return placed.select(*columns).union(stray)

"""Awkward documents for every operator."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, block bigint, _id string, start string, bucket int, line string"

WORDS = "the of and to in is that it was for on with as be at by this from or an".split()


def prose(seed: int, words: int) -> str:
    """Words that differ with the seed, from a fixed rule."""
    out, x = [], seed * 7919 + 1
    for k in range(words):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % len(WORDS)] + "abcdefghij"[x // 64 % 10] + "klmnopqrst"[x // 1024 % 10])
        if k % 12 == 11:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def awkward(spark, extra: list[tuple] = ()):
    """Null, empty, blank, very long, repeated and tied rows, rows without
    doc_id, and extra columns whose names operators use inside."""
    long = prose(99, 30_000)
    texts = [
        (1, prose(1, 80)), (2, prose(1, 80)), (2, prose(1, 80)), (3, None), (4, ""), (5, " \t\n\x0b "), (6, long),
        (7, prose(7, 3)), (8, "x" * 50_000), (None, prose(2, 80)), (None, prose(2, 80)), (None, None), (9, "ünïcödé 漢字 😀 " * 40),
        (10, "12345 @@@ ++ .. <|endoftext|> \x00 \x1c   end"),
        *extra,
    ]
    rows = [(i, t, ["en", "fr", None][n % 3], [None, "s"][n % 2], None if t is None else len(t), n, "x", "y", 0, "z") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3), rows


def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def key(row) -> tuple:
    return tuple((x is None, x if x is not None else 0) for x in row)


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def sha(column):
    return F.sha2(column, 256)

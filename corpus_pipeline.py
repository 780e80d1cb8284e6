"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept.  All but the last return the columns of ``documents``:

language ID       documents without a language go; missing lang values are set
line dedup        repeated and nearly repeated lines go, and documents that
                  had nothing else
near duplicates   one document of each component of the n-gram Jaccard join
                  stays, the one with the least doc_id
PII               spans of personal data are replaced by their kind
packing           pieces of token ids, packed into windows

``n_chars`` follows the text.  Each operator's module defines what it does
with nulls, ties and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, linededup, ngram_join, packing, pii
from tidemark.llm.queries import vocabulary
from tidemark.llm.storage import materialize

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars made to follow the text, if the column is there."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit_profiles(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(linededup.dedupe_lines(docs, drop_emptied=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(pii.redact(docs, pii.train_on(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary(), keep_ids=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return made
        docs = materialize(made, f"stage{number}", done=[docs])

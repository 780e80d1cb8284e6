"""Event logs: JSON lines, Parquet, and the disordered demonstration log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arithmetic import micros
from tidemark.operators.prefix import running, value_blocks

PAYLOAD = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.LongType())])
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("event_time", T.LongType()),
    T.StructField("system_time", T.LongType()), T.StructField("ingest_seq", T.LongType()),
    T.StructField("payload", PAYLOAD),
])

ARRIVAL_COLUMNS = ["event_id", "event_time", "system_time", "ingest_seq", "key", "value"]


def flatten(events: DataFrame) -> DataFrame:
    """Events with their payload's fields as columns, none of them null.

    A missing field fails the query that reads it, as a malformed line does.
    """
    flat = events.select("event_id", "event_time", "system_time", "ingest_seq", "payload.key", "payload.value")
    return flat.select(*[F.coalesce(F.col(c), F.raise_error(F.lit(f"event without {c}")).cast(flat.schema[c].dataType)).alias(c) for c in ARRIVAL_COLUMNS])


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Arrivals of a JSON-lines log; blank lines are skipped, unknown fields
    ignored, and malformed lines and missing fields are errors."""
    return flatten(spark.read.schema(EVENT).option("mode", "FAILFAST").json(path))


def stream_event_log(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The same from a folder of JSON-lines files that come in over time."""
    reader = spark.readStream.schema(EVENT).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return flatten(reader.json(folder))


def disordered_arrivals(events: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """Arrivals made from an ordered ``events`` table (event_id, ts,
    event_type, value): delayed by a rule, and some of them twice."""
    time = micros(F.col("ts"))
    delay = F.pmod(F.col("event_id") * 7919, F.lit(1009)) * 2000000
    own = events.select("event_id", time.alias("event_time"), (time + delay).alias("system_time"), F.col("event_type").alias("key"), F.floor(F.col("value") * 100).cast("bigint").alias("value"))
    copies = F.when(F.pmod(F.col("event_id"), F.lit(50)) == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    twice = own.withColumn("copy_no", F.explode(copies)).withColumn("system_time", F.col("system_time") + F.col("copy_no") * 45000000)
    numbered = twice.withColumn("block", value_blocks(twice, "system_time", block_rows))
    numbered = running(numbered, [], "block", ["system_time", "event_id", "copy_no"], {"ingest_seq": ("sum", F.lit(1).cast("bigint"), True)})
    return numbered.select(F.col("event_id").cast("string").alias("event_id"), "event_time", "system_time", "ingest_seq", "key", "value")

"""Output, drop and snapshot files.

Records are written as compact JSON lines with their fields in alphabetical
order and nulls kept, in one folder for each offset that a run started from:
a run that is repeated after a crash replaces what it wrote before.  Read
back, records are held against their schema and the values of their enums.

Contributors in each output record make a log that grows with the square of a
window's events.  A log may be written without: ``contributors`` is null, the
lines (and those of the drops of that run) are compressed, and ``read_outputs`` makes them from what each version
added.

A snapshot is a chain of versions.  Each holds the watermark's and the progress
marker's values as they are then, and what it added to the windows, ids and
causal records; its list of versions names those it builds on.  Versions that
one pass saved share a folder, where ``saved`` tells them apart.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import DUPLICATE, LATE
from tidemark.operators.revisions import CORRECTION, INITIAL, LATE_UPDATE, restore_contributors
from tidemark.sources.shared import delete, exists, shuffles_freed, touch

WINDOW_ID = "window_id struct<key:string,start:bigint,end:bigint>"
OUTPUT = f"{WINDOW_ID}, value bigint, version bigint, contributors array<string>, reason string, trigger_event_id string, diff struct<old_value:bigint,new_value:bigint,added_event_ids:array<string>,removed_event_ids:array<string>>"
DROP = f"event_id string, {WINDOW_ID}, decision string, watermark_at_decision bigint"


def _sorted(column: Column, kind: T.DataType) -> Column:
    """The value with all struct fields in alphabetical order."""
    if isinstance(kind, T.StructType):
        fields = [_sorted(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def as_json(records: DataFrame) -> DataFrame:
    """One column ``value`` of JSON texts."""
    fields = [_sorted(F.col(f.name), f.dataType).alias(f.name) for f in sorted(records.schema.fields, key=lambda f: f.name)]
    return records.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_log(records: DataFrame, path: str, offset: int | None = None, compression: str = "none") -> None:
    """The records of a run that started after ``offset``."""
    with shuffles_freed(records.sparkSession):
        as_json(records).write.mode("overwrite").text(f"{path}/from={'start' if offset is None else offset}", compression=compression)


#: A file that says that records of a log were written without contributors.
_LEAN = "_without_contributors"


def write_lean_outputs(records: DataFrame, path: str, offset: int | None = None) -> None:
    """The same of output records that have no contributors."""
    touch(records.sparkSession, f"{path}/{_LEAN}")
    write_log(records, path, offset, "gzip")


def clear_log(spark: SparkSession, path: str) -> None:
    delete(spark, path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a log; malformed lines are errors."""
    names = spark.createDataFrame([], schema).columns
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(*names)


def _checked(records: DataFrame, required: list[str], enum: str, values: list[str]) -> DataFrame:
    """The records; a missing field or an unknown enum value fails the query."""

    def or_fail(name: str) -> Column:
        column = F.col(name)
        wrong = F.raise_error(F.concat(F.lit(f"record with {name} "), F.coalesce(column.cast("string"), F.lit("missing")))).cast(records.schema[name].dataType)
        if name == enum:
            return F.when(column.isin(values), column).otherwise(wrong)
        return F.coalesce(column, wrong)

    return records.select(*[or_fail(c).alias(c) if c in required else F.col(c) for c in records.columns])


def read_outputs(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Output records; if not ``whole``, contributors only where lines hold them."""
    required = ["value", "version", "reason", "trigger_event_id"]
    found = _checked(read_log(spark, path, OUTPUT), required, "reason", [INITIAL, LATE_UPDATE, CORRECTION])
    return restore_contributors(found) if whole and exists(spark, f"{path}/{_LEAN}") else found


def read_drops(spark: SparkSession, path: str) -> DataFrame:
    return _checked(read_log(spark, path, DROP), ["event_id", "decision", "watermark_at_decision"], "decision", [DUPLICATE, LATE])


#: Tables of a snapshot that hold what a version added; the others are whole.
ADDED = ("seen", "windows", "causal")


def write_snapshot(tables: dict[str, DataFrame], folder: str, after: list[str], count: int = 1) -> list[str]:
    """Write the tables as ``count`` versions, one for each number of their
    column ``saved`` from 0, that build on the versions ``after``, then point
    to the last; the versions that it builds on, with its own.

    The pointer is written last, so a crash leaves the version before them.
    """
    pass_id = uuid.uuid4().hex
    for name, table in tables.items():
        with shuffles_freed(table.sparkSession):
            table.write.parquet(f"{folder}/{pass_id}/{name}", compression="zstd")
    spark = next(iter(tables.values())).sparkSession
    chain = [*after, *[f"{pass_id}-{n}" for n in range(count)]]
    moment = spark.range(1).select(F.lit(len(chain)).alias("length"), F.current_timestamp().alias("at"), F.array(*map(F.lit, chain)).alias("versions"))
    moment.coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return chain


def read_snapshot(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict[str, DataFrame], list[str]] | None:
    """Tables of the last version, and the versions it is made of; None if there
    is no snapshot.  A snapshot that cannot be read is an error."""
    if not exists(spark, f"{folder}/versions"):
        return None
    chain = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("at")).first()["versions"]
    last = {}  # of each pass, in order
    for version in chain:
        pass_id, number = version.split("-")
        last[pass_id] = int(number)
    found = {}
    for name in names:
        if name in ADDED:
            parts = [spark.read.parquet(f"{folder}/{p}/{name}").where(F.col("saved") <= n) for p, n in last.items()]
        else:
            parts = [spark.read.parquet(f"{folder}/{pass_id}/{name}").where(F.col("saved") == int(number))]
        found[name] = reduce(DataFrame.unionByName, parts).drop("saved")
    return found, list(chain)

"""What operators need of the cluster: shared tables and shipped code.

An operator whose input would otherwise be computed twice, or whose plan
would grow with each iteration, writes it once as Parquet below the folder
that ``spark.checkpoint.dir`` names.  A lost executor then costs a re-read
and nothing more.  Tables go when the interpreter ends, or by ``release``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a table, by its rows and their fixed width, that may be broadcast.
BROADCAST_BYTES = 24_000_000

#: Copies of a row that meets a hot key's rows where it cannot be broadcast.
SALTS = 16

#: Bytes of an Arrow batch; the JVM and the worker hold some of them at once.
BATCH_BYTES = "2m"

_BATCH, _USUAL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Tables that are read a few times are packed quickly.
_QUICK = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.enable.dictionary": "false"}

_written: dict[str, SparkSession] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this subpackage to the executors once for each application.

    Workers then import it wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    folder = tempfile.mkdtemp(prefix="tidemark-")  # the driver serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"tidemark-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as file:
        file.write(os.path.join(top, "__init__.py"), "tidemark/__init__.py")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                file.write(os.path.join(here, name), f"tidemark/llm/{name}")
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this subpackage there for the workers, and with
    Arrow batches of whole texts held small.

    The plan runs later, so the session keeps ``BATCH_BYTES`` as the size of
    its Arrow batches, unless it has a size of its own.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH, _USUAL_BATCH) == _USUAL_BATCH:  # a session's own choice stays
        conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame, label: str = "table", done: Iterable[DataFrame] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    ``done`` are written tables that nothing reads after this one; they go.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**_QUICK).parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    for old in done:
        discard(old)
    return table


def row_bytes(kind: T.DataType, items: int = 0) -> int:
    """Bytes of a value of fixed width; arrays count as ``items`` values."""
    if isinstance(kind, T.StructType):
        return 8 + sum(8 + row_bytes(f.dataType, items) for f in kind.fields)
    if isinstance(kind, T.ArrayType) and items:
        return 24 + items * 8
    if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
        raise ValueError(f"{kind.simpleString()} has no fixed width")
    return 8


def fits(df: DataFrame, limit: int = BROADCAST_BYTES, items: int = 0) -> bool:
    """Whether the table's counted rows stay under so many bytes."""
    return df.count() * row_bytes(df.schema, items) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, to be broadcast if its rows take at most so many bytes.

    For tables of fixed-width columns; beyond that size the join shuffles, to
    the same result.
    """
    return F.broadcast(df) if fits(df, limit) else df


def met(rows: DataFrame, table: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` joined with the ``table`` of one row a key: by broadcast if it
    is ``few``, else with the rows of each key dealt over ``SALTS`` tasks.

    Rows are dealt by a hash of all their columns, so that a task that is run
    again deals them alike.
    """
    if few:
        return rows.join(F.broadcast(table), keys, how)
    salt, = unused(rows, "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def discard(table: DataFrame) -> None:
    """Delete a written table that no later plan reads."""
    path = getattr(table, "written_at", None)
    if path in _written:
        _delete(_written.pop(path), path)


def release(spark: SparkSession) -> None:
    """Delete all tables that operators have written in this session, once
    nothing reads their results any more."""
    for path, owner in list(_written.items()):
        if owner is spark:
            _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_all() -> None:
    for path, spark in _written.items():
        if getattr(spark.sparkContext, "_jsc", None) is None:
            continue
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already when the interpreter ends
            return

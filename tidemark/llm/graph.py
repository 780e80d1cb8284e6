"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def _hooked(edges: DataFrame, both: bool) -> DataFrame:
    """One star round: neighbours of each node are hooked to the least of them.

    ``edges`` has u > v.  With ``both`` a node sees all its neighbours and
    hooks the greater ones (large star), else it sees the lesser ones and
    hooks them and itself (small star).
    """
    seen = edges.select("u", "v")
    if both:
        seen = seen.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = seen.join(least, "u")
    if both:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it is connected with) for all nodes with
    an edge, by alternating star rounds.

    ``edges`` has columns u and v of one orderable type; loops, repeats and
    either direction are fine.  Each round's edges are written to the shared
    folder; the number of rounds grows with the logarithm of the graph.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = materialize(_hooked(_hooked(now, both=True), both=False), "edges", done=[now])
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

"""Duplicates, total order, watermark and lateness.

The watermark is global: the greatest event time of the distinct arrivals up
to and including this one, less the bound.  An arrival is late if its own
event time is under the watermark that it has just moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import BUFFERED, NO_WATERMARK, EngineConfig
from tidemark.operators.prefix import Keep, running, value_blocks

DUPLICATE, LATE = "DuplicateDrop", "LateDrop"


def after_offset(arrivals: DataFrame, offset: int | None) -> DataFrame:
    """Arrivals past a processed ``ingest_seq``; all of them without one."""
    return arrivals if offset is None else arrivals.where(F.col("ingest_seq") > offset)


def order_columns(config: EngineConfig) -> list[str]:
    """The processing order; event_id settles equal keys."""
    return ["system_time", "ingest_seq", "event_id"] if config.mode == BUFFERED else ["ingest_seq", "event_id"]


def mark_first(arrivals: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``first``: whether no earlier arrival has the event_id, and ``seen`` has not."""
    order = Window.partitionBy("event_id").orderBy("ingest_seq", "system_time")
    marked = arrivals.withColumn("first", F.row_number().over(order) == 1)
    if seen is None:
        return marked
    known = seen.select("event_id", F.lit(True).alias("known"))
    return marked.join(known, "event_id", "left").withColumn("first", F.col("first") & F.col("known").isNull()).drop("known")


def _marked_in_blocks(arrivals: DataFrame, seen: DataFrame | None, block: Column, order: list[str], keep: Keep) -> DataFrame:
    """``mark_first``, with the rows dealt to their blocks and moved only there.

    By event_id only the columns of the order are moved, and of these the
    repeats are written.  They go to the blocks with the arrivals: of rows that
    are equal in all these columns as many are no first ones as there are
    repeats, and one that is left over comes before them.
    """
    place = [*order, *(c for c in ("ingest_seq", "system_time", "event_id") if c not in order)]
    repeats = keep(mark_first(arrivals.select(*place), seen).where("not first").drop("first"), "repeats")
    both = arrivals.withColumn("_again", F.lit(0)).unionByName(repeats.withColumn("_again", F.lit(1)), allowMissingColumns=True)
    equal = Window.partitionBy("block", *place).orderBy(F.desc("_again"))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = F.sum("_again").over(whole)
    placed = both.withColumn("block", block).repartition("block")
    marked = placed.withColumn("first", (F.row_number().over(equal) == again + 1) & (F.count(F.lit(1)).over(whole) > 2 * again))
    return marked.where("_again = 0").drop("_again")


def observe(arrivals: DataFrame, config: EngineConfig, top: int | None = None, seen: DataFrame | None = None, keep: Keep | None = None) -> DataFrame:
    """Arrivals with first, block, prev_max, watermark, out_of_order and late.

    ``top`` is the greatest event time, and ``seen`` has the event_ids, of what
    was processed before.  For a duplicate, ``watermark`` is the one its drop
    record states.  With ``keep`` they are written on the way, and reading
    them computes nothing twice.
    """
    order = order_columns(config)
    block = value_blocks(arrivals, order[0], config.block_rows)
    marked = mark_first(arrivals, seen).withColumn("block", block) if keep is None else _marked_in_blocks(arrivals, seen, block, order, keep)
    running_max = running(marked, [], "block", order, {"prev_max": ("max", F.when(F.col("first"), F.col("event_time")), False)}, keep)
    seen = running_max if top is None else running_max.withColumn("prev_max", F.greatest("prev_max", F.lit(top).cast("bigint")))
    watermark = F.greatest("prev_max", "event_time") - config.bound
    if config.mode == BUFFERED:  # every duplicate is met before anything is processed
        at_duplicate = F.lit(NO_WATERMARK if top is None else top - config.bound)
    else:
        at_duplicate = F.coalesce(F.col("prev_max") - config.bound, F.lit(NO_WATERMARK))
    seen = seen.withColumn("watermark", F.when(F.col("first"), watermark).otherwise(at_duplicate))
    return seen.withColumns({
        "out_of_order": F.col("first") & F.coalesce(F.col("event_time") < F.col("prev_max"), F.lit(False)),
        "late": F.col("first") & (F.col("event_time") < F.col("watermark")),
        "advanced": F.col("first") & F.coalesce(F.col("event_time") > F.col("prev_max"), F.lit(True)),
    })


def accepted(observed: DataFrame) -> DataFrame:
    return observed.where("first and not late")


def drops(observed: DataFrame) -> DataFrame:
    """Drop records, of duplicates and of late events; their window is null."""
    nowhere = F.lit(None).cast("struct<key:string,start:bigint,end:bigint>")
    dropped = observed.where("late or not first")
    return dropped.select("event_id", nowhere.alias("window_id"), F.when(F.col("first"), LATE).otherwise(DUPLICATE).alias("decision"), F.col("watermark").alias("watermark_at_decision"))


def progress(observed: DataFrame) -> DataFrame:
    """max_ingest_seq_processed: late events count, duplicates do not."""
    return observed.where("first").agg(F.max("ingest_seq").alias("max_ingest_seq_processed"))


def final_watermark(observed: DataFrame, config: EngineConfig) -> DataFrame:
    top = observed.where("first").agg(F.max("event_time").alias("max_event_time_seen"))
    return top.select("max_event_time_seen", (F.col("max_event_time_seen") - config.bound).alias("watermark"))


def final_state(observed: DataFrame, config: EngineConfig) -> DataFrame:
    """Watermark and progress after the last arrival, in one row."""
    top = observed.where("first").agg(F.max("event_time").alias("max_event_time_seen"), F.max("ingest_seq").alias("max_ingest_seq_processed"))
    return top.select("max_event_time_seen", (F.col("max_event_time_seen") - config.bound).alias("watermark"), "max_ingest_seq_processed")


def ends(observed: DataFrame, config: EngineConfig, every: int) -> list[int]:
    """ingest_seq of each ``every``-th arrival that is no duplicate."""
    placed = running(observed.where("first").select("event_id", "ingest_seq", "block"), [], "block", ["ingest_seq", "event_id"], {"place": ("sum", F.lit(1).cast("bigint"), True)})
    return sorted(r[0] for r in placed.where(F.col("place") % every == 0).select("ingest_seq").collect())


def up_to(arrivals: DataFrame, count: int, seen: DataFrame | None = None) -> DataFrame:
    """Arrivals up to the ``count``-th that is no duplicate, by ingest_seq."""
    firsts = arrivals.groupBy("event_id").agg(F.min("ingest_seq").alias("ingest_seq"))
    if seen is not None:
        firsts = firsts.join(seen.select("event_id"), "event_id", "left_anti")
    last = firsts.select("ingest_seq").orderBy("ingest_seq").limit(count).agg(F.max("ingest_seq"), F.count(F.lit(1))).first()
    return arrivals if last[1] < count else arrivals.where(F.col("ingest_seq") <= last[0])

"""Versioned revisions of each window's sum, and what caused them.

Every accepted event revises each of its windows.  A version's value and
number are running sums over the window's accepted events in processing
order; what a revision adds is its own event, and nothing is ever removed.
The full set of contributors grows with the square of a window's events and
is only made when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import EngineConfig
from tidemark.operators.ordering import order_columns
from tidemark.operators.prefix import running
from tidemark.operators.windows import assign_windows

INITIAL, LATE_UPDATE, CORRECTION = "Initial", "UpdateLateData", "Correction"

WINDOW = ["key", "start", "end"]


def revision_log(accepted: DataFrame, config: EngineConfig, contributors: bool = False, windows: DataFrame | None = None) -> DataFrame:
    """key, start, end, version, value, reason, trigger_event_id, old_value
    (and contributors) of every revision, with its event's columns of order.

    ``windows`` has the state of windows that were revised before.
    """
    placed = assign_windows(accepted, config.window)
    order = order_columns(config)
    totals = running(placed, WINDOW, "block", order, {"total": ("sum", F.col("value"), True), "version": ("sum", F.lit(1).cast("bigint"), True)})
    if contributors:
        totals = _with_contributors(totals)
    if windows is not None:
        before = windows.select(*WINDOW, F.col("value").alias("_value"), F.col("version").alias("_version"), F.col("contributors").alias("_ids"))
        totals = totals.join(before, WINDOW, "left").withColumns({"total": F.col("total") + F.coalesce("_value", F.lit(0)), "version": F.col("version") + F.coalesce("_version", F.lit(0))})
        if contributors:
            totals = totals.withColumn("contributors", F.sort_array(F.concat(F.coalesce("_ids", F.array().cast("array<string>")), "contributors")))
    reason = F.when(F.col("version") == 1, INITIAL).when(F.col("out_of_order"), LATE_UPDATE).otherwise(CORRECTION)
    old = F.when(F.col("version") > 1, F.col("total") - F.col("value"))
    more = ["contributors"] if contributors else []
    return totals.select(*WINDOW, "version", F.col("total").alias("value"), reason.alias("reason"), F.col("event_id").alias("trigger_event_id"), old.alias("old_value"), *[c for c in order if c != "event_id"], *more)


def _with_contributors(totals: DataFrame) -> DataFrame:
    """The sorted ids of each version: those of its block so far, and those of
    the blocks before, so a hot window is not one task."""
    inside = Window.partitionBy(*WINDOW, "block").orderBy("version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = totals.withColumn("_own", F.collect_list("event_id").over(inside))
    blocks = totals.groupBy(*WINDOW, "block").agg(F.collect_list("event_id").alias("_all"))
    earlier = Window.partitionBy(*WINDOW).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*WINDOW, "block", F.flatten(F.collect_list("_all").over(earlier)).alias("_before"))
    joined = local.join(before, [*WINDOW, "block"])
    return joined.withColumn("contributors", F.sort_array(F.concat("_before", "_own"))).drop("_own", "_before")


def restore_contributors(records: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """Output records with the contributors that they were written without:
    the triggers of their window's versions up to their own.

    A window whose earlier versions are not all there is an error.
    """
    named = [F.coalesce(F.col(f"window_id.{c}"), F.raise_error(F.lit(f"record with window {c} missing")).cast(kind)).alias(c) for c, kind in zip(WINDOW, ("string", "bigint", "bigint"))]
    flat = records.select("*", *named, F.col("trigger_event_id").alias("event_id"), F.call_function("div", F.col("version") - 1, F.lit(block_rows)).alias("block"))
    found = _with_contributors(flat.withColumnRenamed("contributors", "_given"))
    wrong = F.raise_error(F.concat(F.lit("record with earlier versions missing: "), F.col("version").cast("string"))).cast("array<string>")
    whole = F.when(F.size("contributors") == F.col("version"), F.col("contributors")).otherwise(wrong)
    return found.withColumn("contributors", F.coalesce("_given", whole)).select(*records.columns)


def contributor_changes(revisions: DataFrame) -> DataFrame:
    """``revisions`` (with contributors) with added and removed: the differences
    of each version's contributors from those of the version before."""
    last = Window.partitionBy(*WINDOW).orderBy("version")
    before = F.coalesce(F.lag("contributors").over(last), F.array().cast("array<string>"))
    both = revisions.withColumn("_before", before)
    return both.withColumns({"added": F.array_sort(F.array_except("contributors", "_before")), "removed": F.array_sort(F.array_except("_before", "contributors"))}).drop("_before")


def mark_contributors(revisions: DataFrame) -> DataFrame:
    """``revisions`` of one log with a mark of each version's contributors.

    A version adds its own event, which no other version of its window has, and
    removes nothing: a window's sets are nested, so those of one size are equal
    and the size, the version number, is the mark.
    """
    return revisions.withColumn("contributors", F.col("version"))


def changed(candidates: DataFrame) -> DataFrame:
    """Candidates (with contributors) that differ from the one before in value
    or contributors; only these are emitted.

    Contributors may be the sets or marks that are equal where the sets are.
    A candidate made by an accepted event always adds it, so ``revision_log``
    emits every one; this is for candidates made otherwise.
    """
    last = Window.partitionBy(*WINDOW).orderBy("version")
    same = F.lag("value").over(last).eqNullSafe(F.col("value")) & F.lag("contributors").over(last).eqNullSafe(F.col("contributors")) & (F.row_number().over(last) > 1)
    return candidates.withColumn("_same", same).where("not _same").drop("_same")


def output_records(revisions: DataFrame) -> DataFrame:
    """Revisions as output records; ``contributors`` must have been asked for."""
    added = F.array("trigger_event_id")
    diff = F.when(F.col("version") > 1, F.struct(F.col("old_value"), F.col("value").alias("new_value"), added.alias("added_event_ids"), F.array().cast("array<string>").alias("removed_event_ids")))
    return revisions.select(F.struct(*WINDOW).alias("window_id"), "value", "version", "contributors", "reason", "trigger_event_id", diff.alias("diff"))


def causal_index(revisions: DataFrame, *more: Column) -> DataFrame:
    """What each version of each window was caused by."""
    return revisions.select(*WINDOW, "version", "trigger_event_id", F.array("trigger_event_id").alias("added_event_ids"), F.array().cast("array<string>").alias("removed_event_ids"), *more)


def explain(index: DataFrame, key: str, start: int, end: int, version: int) -> DataFrame:
    """The causal record of one version; empty if there is none."""
    return index.where((F.col("key") == key) & (F.col("start") == start) & (F.col("end") == end) & (F.col("version") == version))


def window_state(accepted: DataFrame, config: EngineConfig, contributors: bool = False, windows: DataFrame | None = None, each: tuple[str, ...] = ()) -> DataFrame:
    """Value, version (and contributors) of every window after the last event.

    ``windows`` has the state of windows that were revised before.  With
    columns ``each``, what the rows of each of their values add to a window.
    """
    placed = assign_windows(accepted, config.window)
    more = [F.collect_set("event_id").alias("contributors")] if contributors else []
    made = placed.groupBy(*WINDOW, *each).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("version"), *more)
    if windows is not None:
        return summed(made.unionByName(windows.select(*made.columns)))
    return made.withColumn("contributors", F.sort_array("contributors")) if contributors else made


def summed(parts: DataFrame) -> DataFrame:
    """State of windows from what several runs added to each."""
    more = [F.sort_array(F.flatten(F.collect_list("contributors"))).alias("contributors")] if "contributors" in parts.columns else []
    return parts.groupBy(*WINDOW).agg(F.sum("value").alias("value"), F.sum("version").alias("version"), *more)


def reason_counts(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

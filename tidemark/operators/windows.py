"""Assignment of events to windows [start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import SlidingWindow, TumblingWindow, WindowSpec
from tidemark.functions.arithmetic import floor_multiple


def window_starts(time: Column, spec: WindowSpec) -> Column:
    """Starts of the windows that hold the time, ascending."""
    if isinstance(spec, TumblingWindow):
        return F.array(floor_multiple(time, spec.size))
    last = floor_multiple(time, spec.slide)
    first = floor_multiple(time - spec.size, spec.slide) + spec.slide
    step = F.lit(spec.slide).cast("bigint")
    return F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))


def assign_windows(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row for each event and window, with start and end."""
    if isinstance(spec, TumblingWindow):  # no row is multiplied
        placed = events.withColumn("start", floor_multiple(F.col("event_time"), spec.size))
    else:
        assert isinstance(spec, SlidingWindow)
        placed = events.withColumn("start", F.explode(window_starts(F.col("event_time"), spec)))
    return placed.withColumn("end", F.col("start") + spec.size)

"""Column arithmetic on microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_multiple(value: Column, step: int) -> Column:
    """The greatest multiple of ``step`` that is not over ``value``."""
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def floor_div(value: Column, step: int) -> Column:
    """Division rounded towards minus infinity, exact for all longs."""
    return F.call_function("div", floor_multiple(value, step), F.lit(step).cast("bigint"))


def micros(timestamp: Column) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the
    session's zone."""
    since = (timestamp - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1000000).cast("bigint")

"""Running aggregates over a total order without a single-task window.

A window function without PARTITION BY, or over one hot key, sorts everything
in one task.  Here rows fall into blocks of the order; a window runs inside
each block, a second one over the blocks' totals, and both are combined.
Sums, counts and maxima are associative, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Writes a table under a name and reads it again.
Keep = Callable[[DataFrame, str], DataFrame]

#: Quantiles that the driver holds; beyond so many blocks each is split evenly.
MOST_CUTS = 1024


def segment(bounds: Sequence[int], column: str) -> Column:
    """Place of the last of the ascending ``bounds`` that is not over the
    value of a long column; 0 if there is none."""
    found, value = F.lit(list(bounds)).cast("array<bigint>"), F.col(column)
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(found, at + s) <= value, F.lit(False)), at + s).otherwise(at))


def value_blocks(df: DataFrame, column: str, block_rows: int) -> Column:
    """Block number of a long column: by its quantiles, and by even ranges
    between two of them, about ``block_rows`` rows each.

    A block holds at most about a ``MOST_CUTS``th of the rows, wherever the
    values lie, but for rows of one value.
    """
    low, count = df.agg(F.min(column), F.count(F.lit(1))).first()
    wanted = -(-count // block_rows)
    if wanted <= 1 or low is None:
        return F.lit(0).cast("bigint")
    cuts = min(wanted, MOST_CUTS)
    shares = [i / cuts for i in range(1, cuts)] + [1.0]
    found = sorted({low, *(max(low, int(x)) for x in df.approxQuantile(column, shares, 0.1 / cuts))})
    parts = -(-wanted // cuts)
    widths = [max(1, -(-(after - own) // parts)) for own, after in zip(found, [*found[1:], found[-1] + 1])]
    bounds, own = F.lit(found).cast("array<bigint>"), segment(found, column)
    if parts == 1:
        return own.cast("bigint")
    inside = F.coalesce(F.try_subtract(F.col(column), F.get(bounds, own)), F.lit(2**63 - 1))
    part = F.least(F.call_function("div", inside, F.get(F.lit(widths).cast("array<bigint>"), own)), F.lit(parts - 1).cast("bigint"))
    return own * parts + part


def _combined(kind: str, before: Column, own: Column) -> Column:
    if kind == "max":
        return F.greatest(before, own)
    return F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))


def running(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], wanted: dict[str, tuple[str, Column, bool]], keep: Keep | None = None) -> DataFrame:
    """``df`` with running aggregates by ``order`` within ``keys``.

    ``wanted`` maps a new column's name to (``sum`` or ``max``, the value, and
    whether the row itself counts).  ``block`` must not fall as ``order`` rises.
    The totals are made before rows are dealt to blocks, so rows move once.
    With ``keep`` the rows with their blocks' aggregates are written and read
    again, and so are the totals; what comes back moves no rows.  The totals,
    a row of fixed width for each block, are then broadcast.
    """
    total = {"sum": F.sum, "max": F.max}
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    ends = {True: Window.currentRow, False: -1}
    local = df.withColumns({f"_{n}": total[kind](value).over(inside.rowsBetween(Window.unboundedPreceding, ends[own])) for n, (kind, value, own) in wanted.items()})
    if keep is not None:
        local = df = keep(local, "rows")
    totals = df.groupBy(*keys, block).agg(*[total[kind](value).alias(f"_t_{n}") for n, (kind, value, _) in wanted.items()])
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(*keys, block, *[total[kind](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (kind, *_) in wanted.items()])
    joined = local.join(sums if keep is None else F.broadcast(keep(sums, "blocks")), [*keys, block])
    out = joined.withColumns({n: _combined(kind, F.col(f"_b_{n}"), F.col(f"_{n}")) for n, (kind, *_) in wanted.items()})
    return out.drop(*[f"{p}_{n}" for n in wanted for p in ("", "_b")])

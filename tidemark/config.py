"""Settings of a revision pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field

LINE, BUFFERED = "line", "buffered"

#: The watermark of a drop record made before any event was processed.
NO_WATERMARK = -(2**63)


@dataclass(frozen=True)
class TumblingWindow:
    """Windows of ``size`` microseconds that touch, aligned to the epoch."""

    size: int

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("the window size must be positive")


@dataclass(frozen=True)
class SlidingWindow:
    """Windows of ``size`` that start at every multiple of ``slide``.

    With ``slide`` over ``size`` there are gaps; events there are in no window.
    """

    size: int
    slide: int

    def __post_init__(self) -> None:
        if self.size <= 0 or self.slide <= 0:
            raise ValueError("window size and slide must be positive")


WindowSpec = TumblingWindow | SlidingWindow


@dataclass(frozen=True)
class EngineConfig:
    """Lateness bound, windows, and the order in which arrivals are processed.

    ``line`` processes every arrival before the next one is read, so by
    ``ingest_seq``; ``buffered`` reads all of a batch first and then processes
    by ``(system_time, ingest_seq)``.
    """

    window: WindowSpec
    bound: int = 0
    mode: str = LINE
    block_rows: int = field(default=1 << 16)

    def __post_init__(self) -> None:
        if self.bound < 0:
            raise ValueError("the out-of-orderness bound must not be negative")
        if self.mode not in (LINE, BUFFERED):
            raise ValueError(f"mode must be {LINE!r} or {BUFFERED!r}")

"""The pipeline's semantics one event at a time, to test the engine against."""

from __future__ import annotations

from tidemark.config import BUFFERED, NO_WATERMARK, TumblingWindow


def starts(time: int, window) -> list[int]:
    if isinstance(window, TumblingWindow):
        return [time // window.size * window.size]
    return [s for s in range((time - window.size) // window.slide * window.slide, time + 1, window.slide) if s <= time < s + window.size]


def process(arrivals: list[tuple], config) -> tuple[list[tuple], list[tuple]]:
    """Revisions (key, start, version, value, reason, trigger, contributors)
    and drops (event_id, decision, watermark) of arrivals (event_id,
    event_time, system_time, ingest_seq, key, value)."""
    arrivals = sorted(arrivals, key=lambda a: a[3])
    seen, top, windows, outputs, dropped = set(), None, {}, [], []
    queue = []
    for a in arrivals:
        again = a[0] in seen
        seen.add(a[0])
        if again and config.mode == BUFFERED:
            dropped.append((a[0], "DuplicateDrop", NO_WATERMARK))
        else:
            queue.append((a, again))
    if config.mode == BUFFERED:
        queue.sort(key=lambda x: (x[0][2], x[0][3], x[0][0]))
    for (event_id, time, _, _, key, value), again in queue:
        if again:
            dropped.append((event_id, "DuplicateDrop", NO_WATERMARK if top is None else top - config.bound))
            continue
        late_arrival = top is not None and time < top
        top = time if top is None else max(top, time)
        if time < top - config.bound:
            dropped.append((event_id, "LateDrop", top - config.bound))
            continue
        for start in starts(time, config.window):
            total, version, ids = windows.get((key, start), (0, 0, ()))
            total, version, ids = total + value, version + 1, tuple(sorted({*ids, event_id}))
            windows[key, start] = (total, version, ids)
            reason = "Initial" if version == 1 else "UpdateLateData" if late_arrival else "Correction"
            outputs.append((key, start, version, total, reason, event_id, ids))
    return outputs, dropped

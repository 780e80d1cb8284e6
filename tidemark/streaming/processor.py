"""The pipeline as a stateful streaming query.

The watermark and the duplicates are global, so all arrivals share one state:
the greatest event time, the ids seen, and each window's value, version and
contributors.  A micro-batch is processed in processing order, whatever
order and chunks its rows come in.  Records are tagged ``output`` or ``drop``;
outputs carry their contributors and what they added, from which
``output_records`` and ``causal_records`` make the batch engine's records.

State is kept by the RocksDB provider; set
``spark.sql.streaming.stateStore.providerClass`` accordingly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import BUFFERED, NO_WATERMARK, EngineConfig, TumblingWindow
from tidemark.operators.ordering import DUPLICATE, LATE
from tidemark.operators.revisions import CORRECTION, INITIAL, LATE_UPDATE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SCHEMA = (
    "kind string, event_id string, ingest_seq bigint, key string, start bigint, end bigint, value bigint, version bigint, "
    "reason string, old_value bigint, decision string, watermark_at_decision bigint, contributors array<string>, added_event_ids array<string>"
)


class RevisionProcessor(StatefulProcessor):
    """Feeds arrivals through duplicates, watermark, lateness and windows."""

    def __init__(self, config: EngineConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "event_time bigint")
        self.seen = handle.getMapState("seen", "event_id string", "ingest_seq bigint")
        self.windows = handle.getMapState("windows", "key string, start bigint", "value bigint, version bigint, contributors array<string>")

    def _starts(self, time: int) -> list[int]:
        window = self.config.window
        if isinstance(window, TumblingWindow):
            return [time // window.size * window.size]
        first = (time - window.size) // window.slide * window.slide + window.slide
        return list(range(first, time + 1, window.slide))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = [r for chunk in rows for r in chunk.itertuples(index=False)]
        batch.sort(key=lambda r: (r.ingest_seq, r.system_time))
        top = self.top.get()[0] if self.top.exists() else None
        found: list[tuple] = []
        distinct, known = [], set()
        for r in batch:
            if r.event_id in known or self.seen.containsKey((r.event_id,)):
                if self.config.mode == BUFFERED:
                    found.append(self._drop(r, DUPLICATE, top))
                else:
                    distinct.append((r, True))
                continue
            known.add(r.event_id)
            self.seen.updateValue((r.event_id,), (int(r.ingest_seq),))
            distinct.append((r, False))
        if self.config.mode == BUFFERED:
            distinct.sort(key=lambda x: (x[0].system_time, x[0].ingest_seq, x[0].event_id))
        for r, again in distinct:
            if again:
                found.append(self._drop(r, DUPLICATE, top))
                continue
            out_of_order = top is not None and r.event_time < top
            top = int(r.event_time) if top is None else max(top, int(r.event_time))
            if r.event_time < top - self.config.bound:
                found.append(self._drop(r, LATE, top))
                continue
            for start in self._starts(int(r.event_time)):
                found.append(self._revise(r, start, out_of_order))
        if top is not None:
            self.top.update((top,))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        made = pd.DataFrame(found, columns=names)
        yield made.astype({c: "Int64" for c, kind in (x.split() for x in SCHEMA.split(", ")) if kind == "bigint"})

    def _drop(self, r, decision: str, top: int | None) -> tuple:
        mark = NO_WATERMARK if top is None else top - self.config.bound
        return ("drop", r.event_id, int(r.ingest_seq), None, None, None, None, None, None, None, decision, mark, None, None)

    def _revise(self, r, start: int, out_of_order: bool) -> tuple:
        at = (r.key, start)
        old, version, ids = self.windows.getValue(at) if self.windows.containsKey(at) else (None, 0, [])
        value, ids = int(r.value) + (old or 0), sorted([*ids, r.event_id])
        self.windows.updateValue(at, (value, version + 1, ids))
        reason = INITIAL if not version else LATE_UPDATE if out_of_order else CORRECTION
        return ("output", r.event_id, int(r.ingest_seq), r.key, start, start + self.config.window.size, value, version + 1, reason, old, None, None, ids, [r.event_id])

    def close(self) -> None:
        pass


def stream_revisions(arrivals: DataFrame, config: EngineConfig) -> DataFrame:
    """Tagged output and drop records of a streaming DataFrame of arrivals."""
    keyed = arrivals.withColumn("everything", F.lit(0))
    return keyed.groupBy("everything").transformWithStateInPandas(RevisionProcessor(config), SCHEMA, "Append", "None")


def output_records(tagged: DataFrame) -> DataFrame:
    """The batch engine's output records from tagged ones."""
    made = tagged.where(F.col("kind") == "output")
    none = F.array().cast("array<string>")
    diff = F.when(F.col("version") > 1, F.struct("old_value", F.col("value").alias("new_value"), "added_event_ids", none.alias("removed_event_ids")))
    return made.select(F.struct("key", "start", "end").alias("window_id"), "value", "version", "contributors", "reason", F.col("event_id").alias("trigger_event_id"), diff.alias("diff"))


def causal_records(tagged: DataFrame) -> DataFrame:
    """What each version of each window was caused by, from tagged records."""
    made = tagged.where(F.col("kind") == "output")
    return made.select("key", "start", "end", "version", F.col("event_id").alias("trigger_event_id"), "added_event_ids", F.array().cast("array<string>").alias("removed_event_ids"))


def start(arrivals: DataFrame, config: EngineConfig, output_path: str, drop_path: str, checkpoint: str, **trigger):
    """Write outputs and drops below two folders, one subfolder a micro-batch,
    so a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for kind, path in (("output", output_path), ("drop", drop_path)):
            batch.where(F.col("kind") == kind).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    return stream_revisions(arrivals, config).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""The streaming query against the model, whatever the micro-batches, and
across a stop and restart."""

from __future__ import annotations

import pytest

from tests.model import process
from tests.test_engine import EXAMPLE, GOLDEN, SECOND, write_log
from tidemark.config import BUFFERED, EngineConfig, SlidingWindow
from tidemark.sources.events import stream_event_log
from tidemark.plans.pipeline import RevisionRun
from tidemark.streaming.processor import causal_records, output_records, start

ROWS = [*EXAMPLE, ("E2", 18 * SECOND, 130 * SECOND, 5, "A", 2), ("E5", 40 * SECOND, 131 * SECOND, 6, "B", 9), ("E6", 35 * SECOND, 132 * SECOND, 7, "B", -4)]


def records(spark, folder):
    outputs = spark.read.option("basePath", f"{folder}/outputs").parquet(f"{folder}/outputs/*")
    drops = spark.read.option("basePath", f"{folder}/drops").parquet(f"{folder}/drops/*")
    made = sorted((r.key, r.start, r.version, r.value, r.reason, r.event_id, tuple(r.contributors)) for r in outputs.collect())
    return made, sorted((r.event_id, r.decision, r.watermark_at_decision) for r in drops.collect())


def pump(spark, folder, config):
    query = start(stream_event_log(spark, f"{folder}/in", files_per_batch=1), config, f"{folder}/outputs", f"{folder}/drops", f"{folder}/checkpoint")
    query.awaitTermination(120)
    assert query.exception() is None
    query.stop()


@pytest.mark.parametrize("cuts", [[7], [1, 2, 4, 7]])
@pytest.mark.parametrize("config", [GOLDEN, EngineConfig(SlidingWindow(10 * SECOND, 5 * SECOND), 6 * SECOND)])
def test_micro_batches(spark, tmp_path, cuts, config):
    (tmp_path / "in").mkdir()
    first = 0
    for number, last in enumerate(cuts):
        write_log(tmp_path / "in" / f"{number}.jsonl", ROWS[first:last])
        first = last
        pump(spark, tmp_path, config)  # each file after a restart from the checkpoint
    made, dropped = process(ROWS, config)
    assert records(spark, tmp_path) == (sorted(made), sorted(dropped))


def test_buffered_batch(spark, tmp_path):
    """A micro-batch is read whole and then processed by system time."""
    config = EngineConfig(GOLDEN.window, GOLDEN.bound, BUFFERED)
    rows = [(a, b, 300 * SECOND - c, d, e, f) for a, b, c, d, e, f in ROWS]
    (tmp_path / "in").mkdir()
    write_log(tmp_path / "in" / "0.jsonl", rows)
    pump(spark, tmp_path, config)
    made, dropped = process(rows, config)
    assert records(spark, tmp_path) == (sorted(made), sorted(dropped))


def test_records_like_batch(spark, tmp_path):
    """Output and causal records are those of a batch run."""
    (tmp_path / "in").mkdir()
    write_log(tmp_path / "in" / "0.jsonl", ROWS)
    pump(spark, tmp_path, GOLDEN)
    tagged = spark.read.option("basePath", f"{tmp_path}/outputs").parquet(f"{tmp_path}/outputs/*")
    batch = RevisionRun(GOLDEN, spark.createDataFrame(ROWS, "event_id string, event_time bigint, system_time bigint, ingest_seq bigint, key string, value bigint"))
    assert sorted(map(str, output_records(tagged).collect())) == sorted(map(str, batch.outputs.collect()))
    assert sorted(map(str, causal_records(tagged).collect())) == sorted(map(str, batch.causal.collect()))

"""Logs and snapshots whose size follows the events, not their square."""

from __future__ import annotations

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_engine import EXAMPLE, GOLDEN, SCHEMA, SECOND, many, write_log
from tidemark import queries as engine
from tidemark.config import EngineConfig, TumblingWindow
from tidemark.operators.revisions import changed, mark_contributors
from tidemark.plans import pipeline
from tidemark.plans.pipeline import RevisionRun, _same, load_state, replay_check, run_log
from tidemark.sources.logs import read_outputs
from tidemark.sources.shared import scratch

WIDE = EngineConfig(TumblingWindow(1000 * SECOND), 1000 * SECOND)


def paths(log, folder, config=GOLDEN):
    return [log, str(folder / "outputs"), str(folder / "drops"), config, str(folder / "s")]


def size(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file() and not p.name.startswith("."))


@pytest.mark.parametrize("config", [GOLDEN, WIDE])
def test_contributors_are_restored(spark, tmp_path, config):
    """A log written without contributors is read as one that holds them, over stops too."""
    log = write_log(tmp_path / "events.jsonl", many())
    run_log(spark, *paths(log, tmp_path / "a", config))
    for stop in (9, 0):
        run_log(spark, *paths(log, tmp_path / "b", config), stop_after=stop, contributors=False)
    assert all('"contributors":null' in r.value for r in spark.read.text(str(tmp_path / "b/outputs")).collect())
    one, two = (sorted(map(str, read_outputs(spark, str(tmp_path / f"{x}/outputs")).collect())) for x in "ab")
    assert one == two
    assert len(one) > (40 if config is WIDE else 3)


def test_lean_log_needs_all_versions(spark, tmp_path):
    log = write_log(tmp_path / "events.jsonl", EXAMPLE)
    own = paths(log, tmp_path)
    run_log(spark, *own, stop_after=2, contributors=False)
    with pytest.raises(ValueError, match="contributors"):
        run_log(spark, *own, append_logs=False, contributors=False)
    run_log(spark, *own, contributors=False)
    shutil.rmtree(tmp_path / "outputs/from=start")
    with pytest.raises(Exception, match="earlier versions missing"):
        read_outputs(spark, str(tmp_path / "outputs")).collect()


def test_changes_without_sets(spark, data):
    """Change detection moves no sets of contributors, and marks emit what sets do."""
    plan = engine.queries()["change_detection"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    run = RevisionRun(WIDE, spark.createDataFrame(many(), SCHEMA))
    columns = ["key", "start", "end", "version", "value", "contributors"]
    found = []
    for own in (run.revisions(contributors=True), mark_contributors(run.revisions())):
        own = own.select(*columns)
        again = own.where("version % 3 = 2").withColumn("version", F.col("version") + 1)
        emitted = changed(own.where("version % 3 > 0").unionByName(again))
        found.append(sorted(tuple(r) for r in emitted.select(*columns[:4]).collect()))
    assert found[0] == found[1] and len(found[0]) > 20


def test_replay_in_lean_logs(spark, tmp_path):
    """The replay check writes no sets of contributors, and tells differing rows, counts of them and windows apart."""
    log = write_log(tmp_path / "events.jsonl", many())
    assert replay_check(spark, log, str(tmp_path / "w"), WIDE, 9) == {"outputs": True, "drops": True}
    for name in ("full", "resumed"):
        assert all('"contributors":null' in r.value for r in spark.read.text(str(tmp_path / f"w/{name}/outputs")).collect())
    one = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "x string, y bigint")
    assert _same(one, one.orderBy("x")) and not _same(one, one.distinct()) and not _same(one, one.where("x = 'a'"))


@pytest.mark.parametrize("name", ["drop_log_scan", "snapshot_state", "snapshot_windows"])
def test_queries_write_lean_logs(spark, data, monkeypatch, name):
    """Queries that read other files of a run write no sets of contributors on the way."""
    folders = []
    monkeypatch.setattr(engine, "scratch", lambda s, label: folders.append(scratch(s, label)) or folders[-1])
    engine.queries()[name](spark, data)
    lines = spark.read.text(f"{folders[-1]}/outputs")
    assert lines.count() == lines.where(F.col("value").contains('"contributors":null')).count() > 100


def test_snapshots_are_linear(spark, tmp_path):
    """Versions keep what they added: an id is in one of them, however many there are."""
    log = write_log(tmp_path / "events.jsonl", many())
    run_log(spark, *paths(log, tmp_path, WIDE), snapshot_every=5)
    state = load_state(spark, str(tmp_path / "s"))
    saved = spark.read.parquet(*map(str, (tmp_path / "s").glob("*/windows")))
    assert saved.select(F.sum(F.size("contributors"))).first()[0] == 45 and len(state.versions) >= 9
    assert sorted(i for r in state.windows.collect() for i in r.contributors) == sorted(f"E{n}" for n in range(45))


@pytest.mark.parametrize("most", [2, 256])
def test_passes(spark, tmp_path, monkeypatch, most):
    """A pass saves many versions; the logs and the state are those of one run whatever the passes."""
    passes = []
    monkeypatch.setattr(pipeline, "MOST_SAVED", most)
    monkeypatch.setattr(pipeline, "save_state", lambda *a, save=pipeline.save_state: passes.append(a) or save(*a))
    log = write_log(tmp_path / "events.jsonl", many())
    run_log(spark, *paths(log, tmp_path / "a", WIDE))
    run_log(spark, *paths(log, tmp_path / "b", WIDE), snapshot_every=6, contributors=False)
    assert len(passes) - 1 == (1 if most == 256 else 4)
    one, two = (sorted(map(str, read_outputs(spark, str(tmp_path / f"{x}/outputs")).collect())) for x in "ab")
    assert one == two
    one, two = (load_state(spark, str(tmp_path / f"{x}/s")) for x in "ab")
    assert (one.top, one.processed, one.offset) == (two.top, two.processed, two.offset) and len(two.versions) == 8
    assert sorted(map(str, one.windows.collect())) == sorted(map(str, two.windows.collect()))

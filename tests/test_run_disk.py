"""What a run keeps on disk while it goes and when it is over."""

from __future__ import annotations

import random
import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.model import process
from tests.test_engine import GOLDEN, SCHEMA, SECOND, results
from tidemark import queries as engine
from tidemark.config import BUFFERED, LINE
from tidemark.operators.prefix import running
from tidemark.plans.pipeline import EngineState, RevisionRun
from tidemark.sources.shared import scratch, written


def shuffles(spark) -> set[Path]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for folder in folders for p in Path(folder).rglob("shuffle_*")}


def test_drop_log_scan_leaves_no_scratch(spark, data):
    """Drop lines are compressed, and what only the run needed is gone."""
    before, folder = shuffles(spark), Path(scratch(spark, "x").removeprefix("file:")).parent
    had = set(folder.iterdir()) if folder.exists() else set()
    found = engine.queries()["drop_log_scan"](spark, data)
    left = set(folder.iterdir()) - had
    assert [p.name.split("-")[0] for p in left] == ["run"]
    lines = [p for p in next(iter(left)).glob("drops/from=start/part-*")]
    assert lines and all(p.name.endswith(".txt.gz") for p in lines)
    assert found.count() == spark.read.text(f"{next(iter(left))}/drops").count() > 0
    made = lambda: sum(p.stat().st_size for p in shuffles(spark) - before)
    until = time.time() + 20
    while made() > 50_000 and time.time() < until:
        time.sleep(0.2)
    assert made() <= 50_000  # of aggregates; the rows' shuffles took 200,000 and more


def test_written_frees_its_shuffles(spark, tmp_path):
    before = shuffles(spark)
    table = written(spark.range(1000).repartition("id"), str(tmp_path / "t"))
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles(spark) - before and table.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_kept_run_moves_no_rows(spark, tmp_path):
    run = RevisionRun(GOLDEN, spark.createDataFrame([("a", 1, 2, 3, "k", 4)], SCHEMA)).once(str(tmp_path / "o"))
    plan = run.observed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    run.release()
    assert not (tmp_path / "o").exists()


@pytest.mark.parametrize("mode", [LINE, BUFFERED])
@pytest.mark.parametrize("known", [False, True])
def test_kept_run_equals_lazy_run(spark, tmp_path, mode, known):
    """Repeats are the same whether rows meet by id or by place, also of ids seen before."""
    draw = random.Random(7)
    rows = [(f"E{draw.randrange(60)}", draw.randrange(90) * SECOND, draw.randrange(9) * SECOND, n, "AB"[n % 2], n) for n in range(150)]
    config = replace(GOLDEN, mode=mode, block_rows=7)
    before = EngineState(40 * SECOND, None, None, spark.createDataFrame([("E3",), ("E4",), ("none",)], "event_id string")) if known else EngineState()
    run = RevisionRun(config, spark.createDataFrame(rows, SCHEMA), before)
    kept = run.once(str(tmp_path / "o"))
    one, two = (sorted(map(str, r.observed.select(sorted(run.observed.columns)).collect())) for r in (run, kept))
    assert one == two and len(one) == len(rows)
    firsts = kept.observed.where("first").groupBy("event_id").count().collect()
    assert {r[0] for r in firsts} == {r[0] for r in rows} - ({"E3", "E4"} if known else set()) and all(r[1] == 1 for r in firsts)


@pytest.mark.parametrize("mode", [LINE, BUFFERED])
def test_kept_run_of_equal_rows(spark, tmp_path, mode):
    """Of rows that are equal in all columns of the order one is the first, and the others come after it."""
    draw = random.Random(8)
    rows = [(f"E{draw.randrange(60)}", draw.randrange(90) * SECOND, draw.randrange(9) * SECOND, n // 2, "AB"[n % 2], n) for n in range(100)]
    rows = sorted([*rows, *draw.sample(rows, 30), *[rows[0]] * 3], key=lambda r: (r[3], r[0], r[2]))
    config = replace(GOLDEN, mode=mode, block_rows=7)
    kept = RevisionRun(config, spark.createDataFrame(rows, SCHEMA)).once(str(tmp_path / "o"))
    made, dropped = process(rows, config)
    assert results(kept) == (sorted(made), sorted(dropped)) and len(dropped) > 50


def test_totals_move_no_rows(spark):
    """Blocks' totals are made before rows are dealt: one exchange has rows."""
    rows = spark.range(100).select("id", (F.col("id") % 5).alias("block"), F.lit("x").alias("key"))
    plan = running(rows, [], "block", ["id"], {"n": ("sum", F.lit(1).cast("bigint"), True)})._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan

"""Golden walk-through, edge cases and random logs against the model."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.model import process
from tidemark.config import BUFFERED, NO_WATERMARK, EngineConfig, SlidingWindow, TumblingWindow
from tidemark.operators.windows import assign_windows
from tidemark.plans.pipeline import RevisionRun, load_state, replay_check, run_log
from tidemark.sources.events import EVENT, read_event_log
from tidemark.sources.logs import read_drops, read_outputs

SCHEMA = "event_id string, event_time bigint, system_time bigint, ingest_seq bigint, key string, value bigint"
SECOND = 1_000_000
EXAMPLE = [
    ("E1", 12 * SECOND, 100 * SECOND, 1, "A", 5),
    ("E2", 18 * SECOND, 101 * SECOND, 2, "A", 2),
    ("E3", 14 * SECOND, 110 * SECOND, 3, "A", 7),
    ("E4", 11 * SECOND, 120 * SECOND, 4, "A", 3),
]
GOLDEN = EngineConfig(TumblingWindow(10 * SECOND), 6 * SECOND)


def run(spark, rows, config):
    return RevisionRun(config, spark.createDataFrame(rows, SCHEMA))


def results(found: RevisionRun):
    made = [(r.key, r.start, r.version, r.value, r.reason, r.trigger_event_id, tuple(r.contributors)) for r in found.revisions(contributors=True).collect()]
    dropped = [(r.event_id, r.decision, r.watermark_at_decision) for r in found.drops.collect()]
    return sorted(made), sorted(dropped)


def check(spark, rows, config):
    made, dropped = process(rows, config)
    assert results(run(spark, rows, config)) == (sorted(made), sorted(dropped))


def write_log(path, rows):
    lines = [json.dumps({"event_id": a, "event_time": b, "system_time": c, "ingest_seq": d, "payload": {"key": e, "value": f}, "extra": 1}) for a, b, c, d, e, f in rows]
    path.write_text("\n".join([*lines[:1], "  \t", *lines[1:]]) + "\n")
    return str(path)


def test_walk_through(spark):
    found = run(spark, EXAMPLE, GOLDEN)
    outputs = sorted(found.outputs.collect(), key=lambda r: r.version)
    assert [(r.value, r.version, r.reason, r.trigger_event_id, r.contributors) for r in outputs] == [
        (5, 1, "Initial", "E1", ["E1"]),
        (7, 2, "Correction", "E2", ["E1", "E2"]),
        (14, 3, "UpdateLateData", "E3", ["E1", "E2", "E3"]),
    ]
    assert outputs[0].diff is None
    assert outputs[2].diff.asDict() == {"old_value": 7, "new_value": 14, "added_event_ids": ["E3"], "removed_event_ids": []}
    assert [tuple(r) for r in found.drops.collect()] == [("E4", None, "LateDrop", 12 * SECOND)]
    why = found.explain("A", 10 * SECOND, 20 * SECOND, 3).collect()
    assert [(r.trigger_event_id, r.added_event_ids) for r in why] == [("E3", ["E3"])]
    assert found.explain("A", 10 * SECOND, 20 * SECOND, 4).count() == 0


@pytest.mark.parametrize(
    "rows",
    [
        [("a", -1, 1, 1, "k", 1), ("b", -20 * SECOND, 2, 2, "k", 1), ("c", -25 * SECOND, 3, 3, "k", 1)],
        [("a", 5, 1, 1, "k", 1), ("b", 5, 2, 2, "k", 1), ("c", 4, 3, 3, "k", 1), ("c", 9, 4, 4, "k", 1)],
        [("a", 5, 9, 1, "k", 1), ("b", 50, 1, 2, "k", 2), ("a", 7, 1, 3, "k", 4)],
        [("a", 30 * SECOND, 1, 1, "k", 1), ("b", 25 * SECOND, 1, 2, "other", 1)],
        [],
    ],
)
@pytest.mark.parametrize("mode", ["line", BUFFERED])
@pytest.mark.parametrize("bound", [0, 26 * SECOND])
def test_edges(spark, rows, mode, bound):
    check(spark, rows, EngineConfig(TumblingWindow(10 * SECOND), bound, mode, block_rows=2))


def test_windows(spark):
    def of(time, window):
        rows = spark.createDataFrame([("a", time, 1, 1, "k", 1)], SCHEMA)
        return sorted((r.start, r.end) for r in assign_windows(rows, window).collect())

    assert of(12, SlidingWindow(10, 5)) == [(5, 15), (10, 20)]
    assert of(7, SlidingWindow(5, 10)) == []
    assert of(-1, TumblingWindow(10)) == [(-10, 0)]
    assert of(-25, TumblingWindow(10)) == [(-30, -20)]
    assert of(0, SlidingWindow(10, 4)) == [(-8, 2), (-4, 6), (0, 10)]


def test_duplicate_before_anything(spark):
    config = EngineConfig(TumblingWindow(10), 0, BUFFERED)
    rows = [("a", 1, 1, 1, "k", 1), ("a", 1, 2, 2, "k", 1)]
    assert [tuple(r) for r in run(spark, rows, config).drops.collect()] == [("a", None, "DuplicateDrop", NO_WATERMARK)]


@pytest.mark.parametrize("bad", [lambda: TumblingWindow(0), lambda: SlidingWindow(1, 0), lambda: EngineConfig(TumblingWindow(1), -1), lambda: EngineConfig(TumblingWindow(1), 0, "other")])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        bad()


event = st.tuples(st.sampled_from("abcdefgh"), st.integers(-40, 40), st.integers(0, 9), st.sampled_from("kl"), st.integers(-5, 5))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event, max_size=14), st.integers(0, 12), st.sampled_from([TumblingWindow(10), SlidingWindow(10, 4), SlidingWindow(3, 7)]), st.sampled_from(["line", BUFFERED]))
def test_random_logs(spark, events, bound, window, mode):
    rows = [(a, b, c, n, d, e) for n, (a, b, c, d, e) in enumerate(events)]
    config = EngineConfig(window, bound, mode, block_rows=3)
    check(spark, rows, config)
    found = run(spark, rows, config)
    made, dropped = process(rows, config)
    state = {(r.key, r.start): (r.value, r.version, tuple(r.contributors)) for r in found.windows.collect()}
    last = {(m[0], m[1]): (m[3], m[2], m[6]) for m in made}
    assert state == last
    if isinstance(window, TumblingWindow):
        assert len(made) + len(dropped) == len(rows)


def test_log_files(spark, tmp_path):
    log = write_log(tmp_path / "events.jsonl", EXAMPLE)
    assert sorted(map(tuple, read_event_log(spark, log).collect())) == EXAMPLE
    run_log(spark, log, str(tmp_path / "out"), str(tmp_path / "drops"), GOLDEN, str(tmp_path / "snapshots"))
    outputs = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert outputs[0].startswith('{"contributors":["E1","E2","E3"],"diff":{"added_event_ids":["E3"],"new_value":14,"old_value":7,"removed_event_ids":[]}')
    assert '"diff":null' in outputs[2]
    drops = [r.value for r in spark.read.text(str(tmp_path / "drops")).collect()]
    assert drops == ['{"decision":"LateDrop","event_id":"E4","watermark_at_decision":12000000,"window_id":null}']
    run_log(spark, log, str(tmp_path / "out"), str(tmp_path / "drops"), GOLDEN, str(tmp_path / "snapshots"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == outputs


@pytest.mark.parametrize("stop", [1, 2, 3, 4])
def test_stop_and_resume(spark, tmp_path, stop):
    rows = [*EXAMPLE[:2], ("E1", 13 * SECOND, 102 * SECOND, 3, "A", 1), *[(*r[:3], r[3] + 1, *r[4:]) for r in EXAMPLE[2:]]]
    log = write_log(tmp_path / "events.jsonl", rows)
    assert replay_check(spark, log, str(tmp_path / "work"), GOLDEN, stop) == {"outputs": True, "drops": True}


def read_all(spark, folder):
    found = {}
    for name in ("outputs", "drops"):
        found[name] = sorted(r.value for r in spark.read.text(str(folder / name)).collect())
    return found


def many(count=60):
    """A log with late, repeated and out-of-order arrivals."""
    return [(f"E{n * 7 % 45}", (n * 37 % 50) * SECOND, n, n + 1, "AB"[n % 2], n) for n in range(count)]


@pytest.mark.parametrize("every", [1, 7, 100])
def test_snapshot_every(spark, tmp_path, every):
    """Saving the state on the way changes no record; the state that is loaded is the whole run's."""
    rows = many(20 if every == 1 else 60)
    log = write_log(tmp_path / "events.jsonl", rows)
    run_log(spark, log, str(tmp_path / "a/outputs"), str(tmp_path / "a/drops"), GOLDEN, str(tmp_path / "a/s"))
    run_log(spark, log, str(tmp_path / "b/outputs"), str(tmp_path / "b/drops"), GOLDEN, str(tmp_path / "b/s"), snapshot_every=every)
    assert read_all(spark, tmp_path / "a") == read_all(spark, tmp_path / "b")
    one, two = (load_state(spark, str(tmp_path / f"{x}/s")) for x in "ab")
    assert (one.top, one.processed, one.offset) == (two.top, two.processed, two.offset)
    for table in ("seen", "windows", "causal"):
        a, b = getattr(one, table), getattr(two, table)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert len(two.versions) >= (2 if every < 60 else 1)


def test_crash_before_snapshot(spark, tmp_path, monkeypatch):
    """Records written by a run that died before its snapshot are not doubled."""
    from tidemark.plans import pipeline

    log = write_log(tmp_path / "events.jsonl", many())
    whole, broken = ([log, str(tmp_path / f"{x}/outputs"), str(tmp_path / f"{x}/drops"), GOLDEN, str(tmp_path / f"{x}/s")] for x in "ab")
    run_log(spark, *whole)
    run_log(spark, *broken, stop_after=9)
    with monkeypatch.context() as m:
        m.setattr(pipeline, "save_state", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_log(spark, *broken, stop_after=11)
    run_log(spark, *broken)
    assert read_all(spark, tmp_path / "a") == read_all(spark, tmp_path / "b")


def test_flags(spark, tmp_path):
    """Without the snapshot a run starts anew; logs that are not appended to begin anew."""
    log = write_log(tmp_path / "events.jsonl", EXAMPLE)
    paths = [log, str(tmp_path / "outputs"), str(tmp_path / "drops"), GOLDEN, str(tmp_path / "s")]
    run_log(spark, *paths, stop_after=2)
    run_log(spark, *paths, use_snapshot=False)
    whole = read_all(spark, tmp_path)
    assert len(whole["outputs"]) == 3 and len(whole["drops"]) == 1
    run_log(spark, *paths, stop_after=2, use_snapshot=False)
    run_log(spark, *paths, append_logs=False)
    assert len(spark.read.text(str(tmp_path / "outputs")).collect()) == 1
    with pytest.raises(ValueError):
        run_log(spark, *paths[:4], snapshot_every=3)


def test_one_step(spark):
    found = run(spark, EXAMPLE, GOLDEN)
    assert [r.trigger_event_id for r in found.step().outputs.collect()] == ["E1"]
    assert found.step(3).revisions().count() == 3 and found.step(9).drops.count() == 1


def test_records_are_checked(spark, tmp_path):
    good = '{"window_id":{"end":2,"key":"k","start":1},"value":1,"version":1,"contributors":["a"],"reason":"Initial","trigger_event_id":"a","diff":null}'
    for number, (bad, read) in enumerate([(good.replace("Initial", "Unknown"), read_outputs), (good.replace('"version":1,', ""), read_outputs), ('{"event_id":"a","decision":"Lost","watermark_at_decision":1}', read_drops)]):
        (tmp_path / f"{number}.jsonl").write_text(bad + "\n")
        with pytest.raises(Exception, match="record with"):
            read(spark, str(tmp_path / f"{number}.jsonl")).collect()
    (tmp_path / "good.jsonl").write_text(good + "\n")
    assert read_outputs(spark, str(tmp_path / "good.jsonl")).first().reason == "Initial"
    assert read_outputs(spark, str(tmp_path / "nothing")).count() == 0


@pytest.mark.parametrize("outlier", [0, 2**62, -(2**62)])
def test_blocks_are_even(spark, outlier):
    """One far value leaves the others' blocks as they were; blocks never fall as values rise."""
    from tidemark.operators import prefix

    values = [(n * n,) for n in range(4000)] + [(outlier,)]
    for most in (8, 1024):
        prefix.MOST_CUTS, usual = most, prefix.MOST_CUTS
        rows = spark.createDataFrame(values, "v bigint")
        found = sorted(map(tuple, rows.select("v", prefix.value_blocks(rows, "v", 100).alias("b")).collect()))
        prefix.MOST_CUTS = usual
        assert [b for _, b in found] == sorted(b for _, b in found)
        sizes = {b: sum(1 for _, x in found if x == b) for _, b in found}
        assert len(sizes) >= (8 if most == 8 else 30) and max(sizes.values()) <= (700 if most == 8 else 220)


def test_hot_window(spark):
    """One window over many blocks: its contributors are those of the model."""
    rows = [(f"e{n}", n % 7, n, n, "k", 1) for n in range(120)]
    check(spark, rows, EngineConfig(TumblingWindow(100), 50, block_rows=16))


def test_change_detection(spark):
    from tidemark.operators.revisions import changed, contributor_changes

    rows = [("k", 0, 9, 1, 5, ["a"]), ("k", 0, 9, 2, 5, ["a"]), ("k", 0, 9, 3, 5, ["a", "b"]), ("k", 0, 9, 4, 6, ["b"]), ("k", 9, 18, 1, 6, ["b"])]
    made = spark.createDataFrame(rows, "key string, start bigint, end bigint, version bigint, value bigint, contributors array<string>")
    assert sorted((r.start, r.version) for r in changed(made).collect()) == [(0, 1), (0, 3), (0, 4), (9, 1)]
    found = {(r.start, r.version): (r.added, r.removed) for r in contributor_changes(made).collect()}
    assert found[0, 1] == (["a"], []) and found[0, 3] == (["b"], []) and found[0, 4] == ([], ["a"])


def test_bad_lines(spark, tmp_path):
    good = '{"event_id":"a","event_time":1,"system_time":1,"ingest_seq":1,"payload":{"key":"k","value":1}}'
    for number, bad in enumerate(["{broken", '{"event_id":"a","event_time":1,"system_time":1,"ingest_seq":1,"payload":{"key":"k"}}', '{"event_id":"a"}']):
        path = tmp_path / f"{number}.jsonl"
        path.write_text(f"{good}\n{bad}\n")
        with pytest.raises(Exception, match="(?i)malformed|event without|parse"):
            read_event_log(spark, str(path)).collect()
    assert spark.read.schema(EVENT).json(str(tmp_path / "2.jsonl")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    log = write_log(tmp_path / "events.jsonl", EXAMPLE)
    sizes = ["--window-size-micros", "10000000", "--out-of-orderness-bound-micros", "6000000"]
    assert main(["replay-check", "--event-log", log, "--work-dir", str(tmp_path / "w"), *sizes]) == 0
    assert "outputs: same" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "--event-log", log, "--unknown", "1"])

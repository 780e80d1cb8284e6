"""Command line: ``run`` and ``replay-check``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidemark.config import EngineConfig, TumblingWindow
from tidemark.plans.pipeline import replay_check, run_log


def _truth(text: str) -> bool:
    if text not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text == "true"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description="Revisions of windowed sums over an event log.")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("run", "replay-check"):
        command = commands.add_parser(name)
        command.add_argument("--event-log", required=True)
        command.add_argument("--window-size-micros", type=int, required=True)
        command.add_argument("--out-of-orderness-bound-micros", type=int, default=0)
        if name == "run":
            command.add_argument("--output-log", required=True)
            command.add_argument("--drops-log", required=True)
            command.add_argument("--snapshot-dir")
            command.add_argument("--stop-after", type=int, default=0)
            command.add_argument("--snapshot-every", type=int, default=0)
            command.add_argument("--use-snapshot", type=_truth, default=True)
            command.add_argument("--contributors", type=_truth, default=True, help="whether each output line holds its contributors; the reader makes those that are left out")
            command.add_argument("--append-logs", type=_truth, default=None, help="append when a run goes on from a snapshot, unless this says otherwise")
        else:
            command.add_argument("--work-dir", required=True)
            command.add_argument("--crash-after", type=int, default=2)
    return top


def main(arguments: list[str] | None = None) -> int:
    own = parser().parse_args(arguments)
    config = EngineConfig(TumblingWindow(own.window_size_micros), own.out_of_orderness_bound_micros)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if own.command == "run":
        run_log(spark, own.event_log, own.output_log, own.drops_log, config, own.snapshot_dir, own.stop_after, own.snapshot_every, own.use_snapshot, own.append_logs, own.contributors)
        return 0
    same = replay_check(spark, own.event_log, own.work_dir, config, own.crash_after)
    for name, equal in same.items():
        print(f"{name}: {'same' if equal else 'different'}")
    return 0 if all(same.values()) else 1


if __name__ == "__main__":
    sys.exit(main())

"""Command line: run, clean and score by a configuration, validate it, or show how a run's budget is split. Exit codes:
0 done, 2 bad configuration, plan or state, 3 a breaker opened, 4 missing input."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from gleaner import config, flow
from gleaner.operators import embedding
from gleaner.operators.state import IncompatibleState
from gleaner.plans.generate import BreakerOpen
from gleaner.plans.planners import PlanError, allocate, preview
from gleaner.session import ship
from gleaner.sources.readers import FORMATS

#: Where a configuration is looked for if none is named.
PLACES = ("gleaner.yaml", "gleaner.yml", "gleaner.json")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleaner")
    p.add_argument("-c", "--config")
    p.add_argument("--stand-in", action="store_true", help="deterministic stand-ins for the models instead of endpoints")
    commands = p.add_subparsers(dest="command", required=True)
    v = commands.add_parser("validate", help="check the configuration")
    v.add_argument("--for", dest="target", default="run", choices=("run", "clean", "score"))
    for name, what in (("plan", "show how a run's budget is split"), ("run", "plan, generate, clean, judge and write")):
        r = commands.add_parser(name, help=what)
        r.add_argument("--count", type=int)
        r.add_argument("--strategy", action="append")
        r.add_argument("--preview", action="store_true")
        if name == "run":
            r.add_argument("--resume", action="store_true")
            r.add_argument("--discard-state", action="store_true")
    for name, what in (("clean", "run the stages over a file"), ("score", "judge the samples of a file")):
        c = commands.add_parser(name, help=what)
        c.add_argument("input")
        c.add_argument("-o", "--output")
        c.add_argument("--input-format", default="flat", choices=FORMATS)
        c.add_argument("--field-map", type=json.loads, help="JSON object of foreign to own names of fields")
    return p


def _flow(args: argparse.Namespace, cfg: dict, spark: SparkSession) -> flow.Report:
    doubles = args.stand_in
    chats = flow.double_chats if doubles else flow.http_chats
    embed = (lambda: embedding.double_embed()) if doubles else None
    if args.command == "run":
        return flow.run(spark, cfg, args.count, args.strategy, args.preview, args.resume, args.discard_state, chats, embed)
    if args.command == "clean":
        return flow.clean(spark, cfg, args.input, args.output, args.input_format, args.field_map, embed)
    return flow.score(spark, cfg, args.input, args.output, args.input_format, args.field_map, chats)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    path = args.config or next((p for p in PLACES if os.path.exists(p)), None)
    try:
        if path is None:
            raise config.ConfigError(f"no configuration: name one with -c or place {PLACES[0]} here")
        cfg = config.load(path)
        if getattr(args, "output", None):
            cfg["output"]["path"] = args.output
        target = {"validate": getattr(args, "target", "run"), "plan": "run"}.get(args.command, args.command)
        issues = config.check(cfg, target, getattr(args, "count", None), getattr(args, "input", None))
        for i in issues:
            print(f"{i.level}: {i.message}", file=sys.stderr)
        errors = [i.message for i in issues if i.level == "error"]
        if errors:
            return 4 if any("does not exist" in e for e in errors) else 2
        if args.command == "plan":
            split = allocate(cfg["strategies"], args.count if args.count is not None else cfg["plan"]["count"], args.strategy)
            for name, n in preview(split, cfg["run"]["preview_count"]) if args.preview else split:
                print(name, n)
        elif args.command != "validate":
            spark = spark or SparkSession.builder.getOrCreate()
            ship(spark)
            print(_flow(args, cfg, spark).text())
    except (config.ConfigError, PlanError, IncompatibleState, ValueError, OSError, RuntimeError) as e:
        code = 3 if isinstance(e, BreakerOpen) else 2
        print(f"error: {e}", file=sys.stderr)
        return code
    except Exception as e:  # a breaker that opened in a worker comes back inside the engine's own error
        if BreakerOpen.__name__ not in str(e):
            raise
        print("error: a breaker opened; what was written so far stays", file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""The command line: run programs, list primitives, or read programs one after the other."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame

from rasterloom.plans import primitives  # noqa: F401  registers the primitives
from rasterloom.plans.engine import PRIMITIVES, Engine, Image, plain
from rasterloom.plans.graph import Goal
from rasterloom.plans.plugins import load_folder
from rasterloom.plans.syntax import LanguageError, parse_program, shown
from rasterloom.session import session
from rasterloom.sources.sinks import Store, save, suffix_of


#: Rows of a table or an image that are printed.
PRINTED = 10_000


def printed(value: object) -> str:
    """A value as text; of a table or an image the first ``PRINTED`` rows, and that there are more."""
    rows = value.result() if isinstance(value, Image) else value
    if isinstance(rows, DataFrame):
        order = [c for c in ("image_id", "z", "y", "x", "idx") if c in rows.columns]
        found = rows.orderBy(*order).limit(PRINTED + 1) if order else rows.limit(PRINTED + 1)
        held = plain(found)
        return f"{held[:PRINTED]}{' and more' if len(held) > PRINTED else ''}"
    return str(plain(value))


def finish(goal: Goal, value: object) -> None:
    """Print or save a goal's value."""
    if goal.operation == "print":
        print(f"{goal.name}={printed(value)}")
    elif isinstance(value, Image) and not value.whole and suffix_of(goal.name):
        PRIMITIVES["simpleitk"]["WriteImage"].run(value, goal.name)
    elif isinstance(value, Image):
        save(goal.name, value.result())
    else:
        save(goal.name, value)


def run(text: str, path: str | None, args: argparse.Namespace) -> int:
    """Run a program: 2 for errors that are found before it runs, 1 if a goal fails."""
    spark = session(args.master)
    try:
        for folder in getattr(args, "plugins", None) or []:
            load_folder(folder)
        store = getattr(args, "store", None)
        engine = Engine(spark, text, path, store=Store(spark, store) if store else None)
    except LanguageError as e:
        print(e, file=sys.stderr)
        return 2
    for name, make in (("json", lambda: json.dumps(engine.plan.to_json(), indent=2, default=str)), ("dot", engine.plan.to_dot), ("text", engine.plan.to_text), ("syntax", lambda: "\n".join(map(shown, parse_program(text))))):
        target = getattr(args, f"save_{name}", None)
        if target:
            Path(target).write_text(make())
    failed = 0
    for goal in engine.plan.goals:
        try:
            finish(goal, engine.goal(goal))
        except Exception as e:  # a goal that fails doesn't stop the others
            failed = 1
            print(f"{goal.operation} {goal.name}: {e}", file=sys.stderr)
    return failed


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom")
    parser.add_argument("--master", default=None, help="Spark master, if the environment names none")
    parser.add_argument("--store", metavar="DIR", help="keep the tables and images of goals, and use those that are there")
    parser.add_argument("--plugins", metavar="DIR", action="append", help="a folder of modules that register primitives, and of libraries")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("run", help="run a program")
    one.add_argument("file")
    for kind in ("json", "dot", "text", "syntax"):
        one.add_argument(f"--save-{kind}", metavar="PATH")
    commands.add_parser("list-primitives", help="names, with how many arguments they take")
    commands.add_parser("repl", help="run the programs whose paths are read from the input")
    args = parser.parse_args(argv)
    if args.command == "list-primitives":
        for space in sorted(PRIMITIVES):
            for p in sorted(PRIMITIVES[space].values(), key=lambda p: p.name):
                most = "" if p.most == p.least else f"..{p.most}" if p.most is not None else "+"
                print(f"{p.name} {p.least}{most}")
        return 0
    if args.command == "run":
        return run(Path(args.file).read_text(), args.file, args)
    so_far = ""
    for line in sys.stdin:
        if path := line.strip():
            text = Path(path).read_text()
            code = run(so_far + text, path, args)
            if code == 0:  # definitions go on, goals were done
                so_far += "\n".join(shown(c) for c in parse_program(text) if c[0] not in ("print", "save")) + "\n"
    return 0


if __name__ == "__main__":
    sys.exit(main())

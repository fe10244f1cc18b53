"""Command line: ``python -m linelark --archive FOLDER [--limit N] [--store PATH] [--index]``, then type; '#' starts anew, '/quit' ends."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Completer, display, metrics_line
from .streaming.terminal import kept, step


def main() -> None:
    parser = argparse.ArgumentParser(prog="linelark")
    parser.add_argument("--archive", required=True)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--store")
    parser.add_argument("--index", action="store_true")
    args = parser.parse_args()
    if args.limit is not None and args.limit < 1:
        parser.error("--limit must be positive")
    spark = SparkSession.builder.appName("linelark").getOrCreate()
    try:
        engine = Completer.from_directory(spark, args.archive, args.limit, args.store, args.index)
    except (FileNotFoundError, NotADirectoryError) as e:
        parser.error(str(e))
    print("\n".join(f"{name}: {value:.6g}" for name, value in engine.statistics().items()))
    text = ""
    while True:
        try:
            taken = step(_typed(text))
        except (EOFError, KeyboardInterrupt):
            return
        if taken.done:
            return
        lines = display(engine.best(taken.query)) if taken.query else []
        if taken.query:
            print(metrics_line(engine.last_query_metrics))
        print("\n".join(lines) if lines else "No line matches.")
        text = kept(taken, len(lines))


def _typed(text: str) -> str:
    """One line of input, with ``text`` there to be edited where the terminal can."""
    try:
        import readline
    except ImportError:
        return text + input(f"> {text}")
    readline.set_startup_hook(lambda: readline.insert_text(text))
    try:
        return input("> ")
    finally:
        readline.set_startup_hook()


if __name__ == "__main__":
    main()

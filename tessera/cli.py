"""python -m tessera.cli find|inspect|trace|impact …, in the root of a source tree."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description="Questions to the code graph of a source tree")
    parser.add_argument("--root", default=".")
    parser.add_argument("--version", action="version", version="tessera 0.1")
    ask = parser.add_subparsers(dest="question", required=True)
    ask.add_parser("find").add_argument("query")
    ask.add_parser("inspect").add_argument("symbol")
    trace = ask.add_parser("trace")
    trace.add_argument("start")
    trace.add_argument("end")
    impact = ask.add_parser("impact")
    impact.add_argument("symbol", nargs="?")
    impact.add_argument("--diff", action="store_true")
    a = parser.parse_args(argv)
    if a.question == "impact" and bool(a.symbol) == a.diff:
        parser.error("impact takes a symbol or --diff")

    from pyspark.sql import SparkSession

    from .engine import Index, SelectorError
    from .sources.git import NotARepository

    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        index = Index.open(spark, a.root)
        if a.question == "find":
            print(index.find(a.query))
        elif a.question == "inspect":
            print(index.inspect(a.symbol))
        elif a.question == "trace":
            print(index.trace(a.start, a.end))
        else:
            print(index.impact_diff() if a.diff else index.impact(a.symbol))
    except (SelectorError, NotARepository) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

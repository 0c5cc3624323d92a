"""Command line: parse the logs of a folder of cases, or score summaries against labels."""

from __future__ import annotations

import argparse
import json
import logging
import sys


def arguments(given: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="loglattice", description=__doc__)
    parts = top.add_subparsers(dest="what", required=True)
    parse, score = parts.add_parser("parse"), parts.add_parser("evaluate")
    parse.add_argument("root")
    parse.add_argument("out")
    parse.add_argument("--config")
    parse.add_argument("--method", type=int, choices=(1, 2))
    parse.add_argument("--limit", type=int)
    parse.add_argument("--resume", action="store_true")
    score.add_argument("out")
    score.add_argument("review")
    for one in (parse, score):
        for name in ("difficulty", "language", "repository", "post_id", "run_id"):
            one.add_argument(f"--{name.replace('_', '-')}", dest=name)
        one.add_argument("--log-level", default="INFO")
    return top.parse_args(given)


def main(given: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if given is None else given)
    logging.basicConfig(level=args.log_level, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    from pyspark.sql import SparkSession

    from .operators.batch import CASE
    from .plans import run
    from .plans.config import Config, loaded

    spark = SparkSession.builder.appName("loglattice").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    filters = {name: getattr(args, name) for name in CASE if getattr(args, name) is not None}
    if args.what == "parse":
        figures = run.parse_bench(spark, args.root, args.out, loaded(args.config) if args.config else Config(), args.method, args.limit, args.resume, **filters)
        print(json.dumps(figures, default=str))
        return int(bool(figures["failed"] or figures["pending"]))
    _, averages = run.evaluated(spark, args.out, args.review, **filters)
    for row in averages.collect():
        print(json.dumps(row.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())

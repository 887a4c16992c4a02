"""Commands: score a file of rankings, or search for cases and score what is found.

    python -m framequery.plans.commands evaluate --tasks T --rankings R --metadata M --output report.json [--k 1,5,10]
    python -m framequery.plans.commands export --run-id NAME --cases-dir C --frames F.parquet --runs-dir R [--cases a,b]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..functions import encoders
from ..sources import readers, writers
from . import request


def parsed_ks(text: str) -> list[int]:
    parts = [x.strip() for x in text.split(",") if x.strip()]
    if not parts or not all(x.isdecimal() and int(x) > 0 for x in parts):
        raise ValueError("k values must be comma-separated positive integers")
    return [int(x) for x in parts]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="framequery", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    score = commands.add_parser("evaluate")
    for name in ("tasks", "rankings", "metadata"):
        score.add_argument(f"--{name}", required=True)
    score.add_argument("--output", default="report.json")
    score.add_argument("--markdown-output")
    export = commands.add_parser("export")
    for name in ("run-id", "cases-dir", "frames"):
        export.add_argument(f"--{name}", required=True)
    export.add_argument("--cases")
    export.add_argument("--runs-dir", default="runs")
    export.add_argument("--encoder", default="histogram")
    export.add_argument("--top-k", type=int, default=100)
    for command in (score, export):
        command.add_argument("--k", default="1,5,10")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    try:
        ks = parsed_ks(given.k)
        if given.command == "evaluate":
            report = request.evaluate_files(spark, given.tasks, given.rankings, given.metadata, given.output, ks, given.markdown_output)
        else:
            cases = request.select_cases(readers.read_cases(spark, given.cases_dir), given.cases)
            frames = spark.read.parquet(given.frames)
            config = request.Config.of_environment()
            report = request.export_and_evaluate(spark, cases, frames, encoders.load(given.encoder), given.runs_dir, given.run_id, ks, given.top_k, config=config)
    except ValueError as error:
        sys.exit(str(error))
    print(writers.text_summary(report), end="")
    return 0


if __name__ == "__main__":
    main()

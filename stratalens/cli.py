"""python -m stratalens.cli run --source DIR --output DIR | query NAME DIR: thin commands over the library."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stratalens.plans import pipeline, registry
from stratalens.workers import reach


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stratalens")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="files to companies and chunks")
    run.add_argument("--source", required=True)
    run.add_argument("--output", required=True)
    run.add_argument("--skip-embeddings", action="store_true")
    run.add_argument("--dry-run", action="store_true")
    query = commands.add_parser("query", help="show a registered query")
    query.add_argument("name", choices=sorted(registry.queries()))
    query.add_argument("tables")
    given = parser.parse_args(args)
    spark = reach(SparkSession.builder.appName("stratalens").getOrCreate())
    if given.command == "run":
        print(pipeline.run(spark, pipeline.Config(given.source, given.output, skip_embeddings=given.skip_embeddings, dry_run=given.dry_run)))
    else:
        registry.queries()[given.name](spark, given.tables).show(50, False)


if __name__ == "__main__":
    main()

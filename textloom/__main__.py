"""Command line: python -m textloom list | run QUERY SF_DIR [OUT] | ingest JSON OUT | calculator N OUT | fetch LIST OUT."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="textloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries")
    run = commands.add_parser("run", help="run a registered query")
    run.add_argument("query")
    run.add_argument("sf_dir")
    run.add_argument("out", nargs="?", help="Parquet folder; shown if left out")
    ingest = commands.add_parser("ingest", help="validate conversations in JSON documents and write them")
    ingest.add_argument("path")
    ingest.add_argument("out")
    ingest.add_argument("--source", default="custom")
    problems = commands.add_parser("calculator", help="write generated problems")
    problems.add_argument("n", type=int)
    problems.add_argument("out")
    problems.add_argument("--seed", type=int, default=42)
    fetched = commands.add_parser("fetch", help="fetch the files of a CSV list with the columns url and name")
    fetched.add_argument("list")
    fetched.add_argument("out")
    args = parser.parse_args(argv)

    from textloom import plans
    from textloom.operators.synth import calculator_problems
    from textloom.sources.fetch import fetch
    from textloom.sources.readers import ingest_custom
    from textloom.sources.writers import write_once

    if args.command == "list":
        print("\n".join(sorted(plans.QUERIES)))
        return
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if args.command == "run":
        out = plans.QUERIES[args.query](spark, args.sf_dir)
        out.write.mode("overwrite").parquet(args.out) if args.out else out.show(50, truncate=80)
    elif args.command == "ingest":
        rows = ingest_custom(spark.read.text(args.path, wholetext=True), args.source)
        rows.groupBy("reject_reason").count().show(truncate=False)
        valid = rows.where("reject_reason is null").select("messages", "source")
        if valid.isEmpty():
            raise SystemExit("no valid conversation")
        write_once(valid, args.out)
    elif args.command == "fetch":
        fetch(spark.read.schema("url string, name string").csv(args.list, header=True), args.out).show(1000, truncate=False)
    else:
        write_once(calculator_problems(spark, args.n, args.seed), args.out)


if __name__ == "__main__":
    main()

"""Commands for spark-submit: compare two logs, compare a fork with its origin, archive a log."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidelog.operators import diff
from tidelog.sources import archives


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidelog", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    tables = commands.add_parser("diff-tables", help="compare two Parquet logs")
    tables.add_argument("a")
    tables.add_argument("b")
    fork = commands.add_parser("diff-fork", help="compare a forked stream with its origin")
    fork.add_argument("log")
    fork.add_argument("category")
    fork.add_argument("id")
    for p in (tables, fork):
        p.add_argument("--output", required=True, help="folder for the summary and the samples")
        p.add_argument("--samples", type=int, default=1000)
    archive = commands.add_parser("archive", help="append new events to a folder of cpio files")
    archive.add_argument("log")
    archive.add_argument("folder")
    archive.add_argument("--create-initial", action="store_true")
    args = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    if args.command == "archive":
        print(archives.archive_new_events(spark.read.parquet(args.log), args.folder, args.create_initial), "files written")
        return
    if args.command == "diff-tables":
        sides = spark.read.parquet(args.a), spark.read.parquet(args.b)
    else:
        sides = diff.forked_pair(spark.read.parquet(args.log), args.category, args.id)
    compared = diff.diff(*map(diff.diff_events, sides))
    diff.summary(compared).orderBy("class", "side", "type").write.mode("overwrite").csv(f"{args.output}/summary", sep="\t", header=True)
    diff.write_samples(compared, f"{args.output}/samples", args.samples)


if __name__ == "__main__":
    main()

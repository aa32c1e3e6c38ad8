"""Command line: python -m engramflow.cli COMMAND ..."""

from __future__ import annotations

import argparse


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="engramflow", description="Run registered queries and imports on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of registered queries")
    run = commands.add_parser("run", help="run a query over a directory of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--out", help="write Parquet there instead of showing rows")
    explain = commands.add_parser("explain", help="the physical plan of a query")
    explain.add_argument("name")
    explain.add_argument("tables")
    load = commands.add_parser("import", help="read a directory of text and JSON files into blocks and segments")
    load.add_argument("root")
    load.add_argument("out")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from .plans import registry

    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("engramflow").getOrCreate()
    if args.command == "import":
        from .operators.segments import segment_files
        from .sources.files import read_blocks, scan

        blocks = read_blocks(scan(spark, args.root).where("supported"))
        blocks.write.mode("overwrite").parquet(f"{args.out}/blocks")
        good = spark.read.parquet(f"{args.out}/blocks").where("error IS NULL")
        segment_files(good.select("source_key", "position", "text", "boundary", F.lit("prose").alias("style"), F.lit("body").alias("role"))).write.mode("overwrite").parquet(f"{args.out}/segments")
        return 0
    df = registry.queries()[args.name](spark, args.tables)
    if args.command == "explain":
        df.explain("formatted")
    elif args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(50, truncate=100)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""``python -m gradloom NAME FOLDER OUT``: run a registered query over a folder of tables and write its result as Parquet."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    from .plans import queries

    p = argparse.ArgumentParser(prog="gradloom", description=__doc__)
    p.add_argument("name", choices=sorted(queries.QUERIES))
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE", help="Spark settings")
    args = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"gradloom {args.name}").config(map=dict(x.split("=", 1) for x in args.conf)).getOrCreate()
    queries.QUERIES[args.name](spark, args.folder).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()

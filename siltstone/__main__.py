"""python -m siltstone query NAME FOLDER | ingest SOURCE TARGET | audit FOLDER TABLE | experiments [DIMENSION]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="siltstone", description="Queries, ingestion and audits of a text corpus.")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in (("query", ("name", "folder")), ("ingest", ("source", "target")), ("audit", ("folder", "table"))):
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
    sub.choices["query"].add_argument("--out", help="write Parquet here instead of showing rows")
    sub.add_parser("experiments").add_argument("dimension", nargs="?")
    asked = parser.parse_args(argv)
    if asked.command == "experiments":
        from siltstone.operators.runs import experiments

        print(*experiments(asked.dimension), sep="\n")
        return
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    if asked.command == "query":
        from siltstone.plans import catalogue

        rows = catalogue.queries()[asked.name](spark, asked.folder)
        rows.write.parquet(asked.out) if asked.out else rows.show(truncate=False)
    elif asked.command == "ingest":
        from siltstone.streaming.ingest import ingest

        ingest(spark, asked.source, f"{asked.target}/passages", f"{asked.target}/checkpoint", failures=f"{asked.target}/failures").awaitTermination()
    else:
        from siltstone.operators.profiling import null_profile

        null_profile(spark.read.parquet(f"{asked.folder}/{asked.table}.parquet")).show()


if __name__ == "__main__":
    main()

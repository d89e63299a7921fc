"""python -m quillgraph list | run QUERY FOLDER [--rows N] | explain QUERY FOLDER"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    parser.add_argument("verb", choices=("list", "run", "explain"))
    parser.add_argument("query", nargs="?")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--rows", type=int, default=20)
    got = parser.parse_args(args)
    from quillgraph.plans.registry import QUERIES

    if got.verb == "list":
        print("\n".join(sorted(QUERIES)))
        return
    if got.query not in QUERIES or not got.folder:
        parser.error("a known query and a folder of tables are needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    df = QUERIES[got.query](spark, got.folder)
    if got.verb == "explain":
        df.explain("formatted")
    else:
        df.show(got.rows, truncate=80)


if __name__ == "__main__":
    main()

"""The driver's tables seen as a literature graph: documents and orders are papers, line items contributions.

An order cites the one and two orders before it of the same customer. Line items of one part, by ship date, make
typed relations between their orders. Each view comes with the SQL that DuckDB builds it by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, text, source, lang of each document."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), "text", "source", "lang")


PAPERS = "papers AS (SELECT doc_id AS id, substr(text, 1, 60) AS title, text, source, lang FROM documents)"


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, collection, year, date of each order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("collection"), F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))


WORKS = "works AS (SELECT o_orderkey AS id, o_custkey AS collection, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)"


def cites(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    """src cites dst: distinct pairs, with columns of the citing order."""
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", *carried, F.lag("o_orderkey", 1).over(order).alias("a"), F.lag("o_orderkey", 2).over(order).alias("b"))
    return o.select(F.col("o_orderkey").alias("src"), *carried, F.explode(F.array("a", "b")).alias("dst")).where("dst IS NOT NULL")


CITES = """cites AS (SELECT src, dst FROM (SELECT o_orderkey AS src, unnest([lag(o_orderkey, 1) OVER w, lag(o_orderkey, 2) OVER w]) AS dst FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE dst IS NOT NULL)"""

RELATIONS = {"A": "supports", "N": "builds_on", "R": "contradicts"}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, rel, confidence, similarity, year: from a line item's order to that of the part's next line item."""
    order = W.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    rel = F.col("l_returnflag")
    for flag, name in RELATIONS.items():
        rel = F.when(F.col("l_returnflag") == flag, F.lit(name)).otherwise(rel)
    return (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("src"), F.lead("l_orderkey").over(order).alias("dst"), rel.alias("rel"), (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"), (F.col("l_tax") * 10).alias("similarity"), F.year("l_shipdate").alias("year"))
        .where("dst IS NOT NULL")
    )


EDGES = """edges AS (SELECT * FROM (SELECT l_orderkey AS src, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS dst,
  CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'N' THEN 'builds_on' WHEN 'R' THEN 'contradicts' ELSE l_returnflag END AS rel, 1.0::DOUBLE - l_discount * 5 AS confidence, l_tax * 10 AS similarity, year(l_shipdate)::INT AS year FROM lineitem) WHERE dst IS NOT NULL)"""

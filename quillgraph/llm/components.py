"""Connected components by alternating large and small stars; every step is a join or an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, release

#: Edges of a task: a small graph is not spread over all shuffle partitions, which would leave thousands of tiny files a step.
EDGES_A_TASK = 100_000


def _with_least(edges: DataFrame, tasks: int) -> DataFrame:
    """u, v and the least v of each u. The aggregate has one row a node, so a node with many edges is one skewed key of a join, which Spark splits."""
    least = edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("least")).coalesce(tasks)
    return edges.join(least, edges["u"] == least["at"]).select("u", "v", "least").coalesce(tasks)


def large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().coalesce(tasks)
    m = _with_least(both, tasks).withColumn("m", F.least("u", "least"))
    return m.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks)


def small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct().coalesce(tasks)
    m = _with_least(down, tasks)
    return m.select("v", F.col("least").alias("to")).where(F.col("v") != F.col("to")).unionByName(m.select(F.col("u").alias("v"), F.col("least").alias("to"))).select(F.col("v").alias("u"), F.col("to").alias("v")).distinct().coalesce(tasks)


def connected(edges: DataFrame) -> DataFrame:
    """node, root of the nodes that have edges (columns u, v) and are not the least of their component."""
    edges = checkpointed(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = 1 + edges.count() // EDGES_A_TASK
    seen = None
    while True:
        edges = checkpointed(small_star(large_star(edges, tasks), tasks))
        release(edges.sparkSession)
        # Only two numbers reach the driver: enough to see that nothing changed.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now

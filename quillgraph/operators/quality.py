"""Lints over the graph: each is a plan of its own, and their findings are one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.identity import LEAST_TITLE, title_key


def lints(titles: DataFrame, works: DataFrame, edges: DataFrame, low: float = 0.55) -> DataFrame:
    """lint, target, n: duplicate titles, edges within one paper, isolated papers, lineage against time, and weak edges."""

    def flag(name, df, target):
        return df.groupBy(target.cast("string").alias("target")).agg(F.count("*").alias("n")).select(F.lit(name).alias("lint"), "target", "n")

    pair = F.concat(F.col("src").cast("string"), F.lit(">"), F.col("dst").cast("string"))
    keyed = titles.select(title_key(F.coalesce("title", F.lit(""))).alias("key")).where(F.length("key") >= LEAST_TITLE)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    years = works.select("id", "year")
    dated = edges.where("rel = 'builds_on'").join(years.select(F.col("id").alias("src"), F.col("year").alias("a")), "src").join(years.select(F.col("id").alias("dst"), F.col("year").alias("b")), "dst")
    found = [
        flag("duplicate_paper", keyed, F.col("key")).where("n > 1"),
        flag("intra_paper_edge", edges.where("src = dst"), F.col("src")),
        flag("isolated_paper", works.select("id").join(ends, "id", "left_anti"), F.col("id")),
        flag("precedence_year_conflict", dated.where("a < b"), pair),
        flag("low_confidence_edge", edges.where(F.col("confidence") < low), pair),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

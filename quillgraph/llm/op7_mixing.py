"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target of tokens: its weight's share of `scale` times all tokens, but at most `most`
times what it has; what is above is shared again among the others by weight (water filling). A source takes
whole passes over its documents as often as the target allows, and for the rest the documents whose
hash is below a threshold. Thresholds come from histograms: tokens are summed by source and hash
bucket, the bucket in which the budget ends is refined by the next bits of the hash, and only its rows
are read for that. Nothing is sorted, and a hot source is summed on the map side like any other. The
threshold ends where the taken tokens are nearest to the target, so a source misses it by half of one
document's size at most.

Thresholds are nested: with a larger budget a source keeps what a smaller one took. The hash is of the
id alone, so reruns agree, and rows that repeat an id fall on the same side.

Nulls and odd rows: a null text has size 0; null is a source of its own, last in order; a null id is hashed as
the empty text. A source without tokens has target 0. An empty table gives an empty result. Columns
other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, table

WEIGHTS = (3, 1, 2)
SCALE, MOST = 1.5, 2
#: Bits of the hash, and bits that each histogram looks at. What three histograms leave is split by whole hashes.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 3

#: Sources whose thresholds are sent to every task, at most: then a hot source needs no shuffle.
BROADCAST_ROWS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def hash_of(column: str) -> Column:
    """60 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, scale: float = SCALE, most: int = MOST) -> DataFrame:
    """source, source_size -> also target. One row a source: windows over all of them see the list of sources only."""
    order = W.orderBy(F.col("source").isNull(), "source")
    everything = W.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    level = (
        (F.lit(scale) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    )
    leveled = ranked.withColumn("level", level)
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return leveled.withColumn("final", final).select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("final"), F.col("cap").cast("double"))).alias("target"))


def sizes_of(df: DataFrame, id_col: str, source_col: str, size: Column) -> DataFrame:
    """source, size, id, hash of each row of df."""
    return checkpointed(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("hash", hash_of("id")))


def thresholds(sized: DataFrame, weights: Sequence[int] = WEIGHTS, scale: float = SCALE, most: int = MOST) -> DataFrame:
    """source, source_size, target, whole (passes), upto (hashes up to it are taken once more): one row a source, sent to every task if they are few."""
    totals = checkpointed(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, scale, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    few = totals.count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    # before: tokens below the bucket under refinement; prefix: the bucket's leading bits.
    ends = totals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("before", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    for step in range(1, LEVELS + 2):
        keep = HASH_BITS - LEVEL_BITS * step
        above = HASH_BITS - LEVEL_BITS * (step - 1)
        bucket = F.shiftright("hash", keep) if step <= LEVELS else F.col("hash")
        b, e = sized.alias("b"), ends.alias("e")
        inside = F.col("b.source").eqNullSafe(F.col("e.source")) & (F.shiftright(F.col("b.hash"), above) == F.col("e.prefix"))
        histogram = b.join(small(e), inside).groupBy("b.source", bucket.alias("bucket")).agg(F.sum("b.size").alias("tokens"))
        walked = histogram.alias("h").join(ends.alias("e"), F.col("h.source").eqNullSafe(F.col("e.source"))).select("e.*", "bucket", "tokens")
        below = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        walked = walked.withColumn("below", F.col("before") + below)
        # A bucket holds the end while what comes before it is within the budget: the last such one is refined.
        holds = F.col("below") <= F.col("rest") if step <= LEVELS else F.col("below") + F.col("tokens") / 2 < F.col("rest")
        found = walked.where(holds).groupBy("source").agg(F.max_by(F.struct("below", "bucket"), "bucket").alias("at"))
        joined = ends.drop("before").alias("e").join(found.alias("f"), F.col("e.source").eqNullSafe(F.col("f.source")), "left")
        columns = ["e.source", "e.source_size", "e.target", "e.whole", "e.rest"]
        if step <= LEVELS:
            ends = checkpointed(joined.select(*columns, F.coalesce("f.at.below", F.lit(0)).alias("before"), F.coalesce("f.at.bucket", F.lit(0)).alias("prefix")))
        else:
            # Without one in the last bucket, the hashes below the bucket.
            ends = joined.select(*columns, F.coalesce(F.col("f.at.bucket"), F.shiftleft(F.col("e.prefix"), HASH_BITS - LEVEL_BITS * LEVELS) - 1).alias("upto"))
    return small(checkpointed(ends))


def mix(df: DataFrame, id_col: str, source_col: str, size: Column, weights: Sequence[int] = WEIGHTS, scale: float = SCALE, most: int = MOST) -> DataFrame:
    """id_col, source, size, source_size, target, copies, taken of each row of df; size is a long expression over df."""
    sized = sizes_of(df, id_col, source_col, size)
    b, e = sized.alias("b"), thresholds(sized, weights, scale, most).alias("e")
    copies = F.col("e.whole") + (F.col("b.hash") <= F.col("e.upto")).cast("long")
    return b.join(e, F.col("b.source").eqNullSafe(F.col("e.source"))).select(
        F.col("b.id").alias(id_col), "b.source", "b.size", "e.source_size", "e.target", copies.alias("copies"), (copies * F.col("b.size")).alias("taken")
    )


def take(df: DataFrame, id_col: str, source_col: str, size: Column, weights: Sequence[int] = WEIGHTS, scale: float = SCALE, most: int = MOST) -> DataFrame:
    """The rows of df with their columns, each as often as the mix takes it. With few sources no row is shuffled."""
    ends = thresholds(sizes_of(df, id_col, source_col, size), weights, scale, most)
    d, e = df.alias("d"), ends.select(F.col("source").alias("mixed source"), "whole", "upto").alias("e")
    copies = F.col("e.whole") + (hash_of(f"d.{id_col}") <= F.col("e.upto")).cast("long")
    taken = d.join(e, F.col(f"d.{source_col}").eqNullSafe(F.col("e.mixed source"))).where(copies > 0)
    return taken.select("d.*", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("mixed copy")).drop("mixed copy")


def words_in(column: str) -> Column:
    """The number of words. Each becomes one letter, so no list of a text's words is made."""
    letters = F.regexp_replace(F.regexp_replace(F.col(column), WORD, "x"), "[^x]+", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), "doc_id", "source", words_in("text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
f AS (SELECT level AS final FROM l WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * final, cap::DOUBLE)) AS target FROM l LEFT JOIN f ON true),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, hash, sum(size)::BIGINT AS tokens FROM d GROUP BY source, hash),
c AS (SELECT g.source, g.hash, tokens, coalesce(sum(tokens) OVER (PARTITION BY g.source ORDER BY g.hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT d.doc_id, d.size, w.source_size, w.target,
  (d.size * (w.whole + CASE WHEN c.below + c.tokens / 2.0 < w.target - w.whole * w.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.hash = d.hash
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLE = {"op7_mixing": ORACLE_SQL}

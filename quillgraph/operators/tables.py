"""Table maintenance: upserts, bulk loads, versions and roll-back, as joins over immutable tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators.graph import checkpointed


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], mark: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """old with new's rows merged by key: new values win, nulls too; columns in `keep` hold their old values where they have one.

    Keys that are null match nothing; a key that new has twice gives two rows; columns that old lacks are dropped.
    """
    n = new.select(*[F.col(c).alias(f"__new_{c}") for c in new.columns], F.lit(True).alias("__new"))
    same = None
    for k in keys:
        c = F.col(k) == F.col(f"__new_{k}")
        same = c if same is None else same & c
    joined = old.join(n, same, "full_outer")
    fresh = F.col("__new")
    value = lambda c: F.coalesce(c, f"__new_{c}") if c in keep or c in keys else F.when(fresh, F.col(f"__new_{c}")).otherwise(F.col(c))
    columns = [value(c).alias(c) if c in new.columns else F.col(c) for c in old.columns]
    if mark:
        columns.append(F.coalesce(fresh, F.lit(False)).alias(mark))
    return joined.select(*columns)


def add_edge(edges: DataFrame, src, dst, rel: str, allowed: Sequence[str]) -> DataFrame:
    """edges with one more; an unknown relation is an error."""
    if rel not in allowed:
        raise ValueError(f"unknown relation {rel!r}")
    one = edges.sparkSession.createDataFrame([(src, dst, rel)], edges.select("src", "dst", "rel").schema)
    return edges.unionByName(one, allowMissingColumns=True).dropDuplicates(["src", "dst", "rel"])


def bulk_edges(edges: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Edges of known relations, each once; others are skipped."""
    return edges.where(F.col("rel").isin(*allowed)).dropDuplicates(["src", "dst", "rel"])


def tag_untagged(nodes: DataFrame, collection: str) -> DataFrame:
    return nodes.withColumn("collection", F.coalesce("collection", F.lit(collection)))


def rollback(papers: DataFrame, dependants: dict[str, DataFrame], version: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What remains without a version's papers and the rows that depend on them (by paper_id)."""
    gone = papers.where(F.col("version") == version).select(F.col("id").alias("paper_id"))
    left = papers.where(~F.col("version").eqNullSafe(F.lit(version)))
    return left, {n: t.join(gone, "paper_id", "left_anti") for n, t in dependants.items()}


def proposed(found: DataFrame, known: DataFrame, day: str) -> DataFrame:
    """Rows of `found` (with keys: names of the work) of which no name is known (key), marked as proposed in the day's batch. Rows without names are proposed."""
    rows = found.withColumn("at", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    held = rows.select("at", F.explode("keys").alias("key")).join(known.select("key").distinct(), "key", "left_semi").select("at").distinct()
    return rows.join(held, "at", "left_anti").drop("at", "keys").withColumns({"batch": F.lit(f"batch-{day}"), "status": F.lit("proposed")})


def merged_batch(pending: DataFrame, fresh: DataFrame) -> DataFrame:
    """A day's second scan goes behind what its batch holds: `place` counts on within each batch."""
    last = pending.groupBy("batch").agg(F.max("place").alias("last"))
    placed = fresh.withColumn("n", F.row_number().over(W.partitionBy("batch").orderBy("paper_id"))).join(last, "batch", "left")
    return pending.unionByName(placed.withColumn("place", F.coalesce("last", F.lit(0)) + F.col("n")).drop("last", "n"))


def event_rows(events: DataFrame, time: str, held: DataFrame | None = None, version: str = "1.0") -> DataFrame:
    """Events (run_id, ...) as a ledger keeps them: `order` without gaps within each run, behind what the ledger holds, and `event_id` from both."""
    rest = [c for c in events.columns if c not in ("run_id", time)]
    n = F.row_number().over(W.partitionBy("run_id").orderBy(time, *rest))
    rows = events.withColumn("order", n.cast("long"))
    if held is not None:
        last = held.groupBy("run_id").agg(F.max("order").alias("last"))
        rows = rows.join(last, "run_id", "left").withColumn("order", F.col("order") + F.coalesce("last", F.lit(0))).drop("last")
    place = F.col("order").cast("string")
    return rows.withColumn("event_id", F.concat(F.col("run_id").cast("string"), F.lit(":e"), F.when(F.length(place) < 6, F.lpad(place, 6, "0")).otherwise(place))).withColumn("schema_version", F.lit(version))


def staged(papers: DataFrame, contributions: DataFrame, relations: DataFrame, limit: int = 38) -> DataFrame:
    """What a view reveals step by step: stage 1 the papers that contribute, 2 contributions and where they are stated, 3 relations among them.

    papers: id, title; contributions: id, paper_id, statement; relations: src, dst, relation. Papers that are not held go by their id.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    used = contributions.select(F.col("paper_id").alias("id")).distinct().join(papers.select("id", "title"), "id", "left")
    node = lambda rows, stage, label: rows.select(F.lit(stage).alias("stage"), text("id").alias("id"), label.alias("label"), none.alias("src"), none.alias("dst"))
    edge = lambda rows, stage, label, src, dst: rows.select(F.lit(stage).alias("stage"), none.alias("id"), label.alias("label"), text(src).alias("src"), text(dst).alias("dst"))
    return (
        node(used, 1, F.coalesce(F.col("title"), text("id")))
        .unionByName(node(contributions, 2, T.shortened(F.col("statement"), limit)))
        .unionByName(edge(contributions, 2, F.lit("stated_in"), "id", "paper_id"))
        .unionByName(edge(relations, 3, F.col("relation"), "src", "dst"))
    )

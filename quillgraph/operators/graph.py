"""Graph operators over edge tables with columns src and dst: every one a plan of joins and aggregations.

Iterative operators keep their state in reliable checkpoints and stop on an empty frontier; only counts reach the driver.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Tables of levels that a closure reads side by side.
MOST_LEVELS = 4


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the cluster's folder; a folder of this machine only where none is named."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both", rel: str | None = None) -> DataFrame:
    """node, neighbour, rel, way of the given nodes (column node)."""
    e = edges if rel is None else edges.where(F.col("rel") == rel)
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("neighbour"), "rel", F.lit("out").alias("way"))
    into = e.select(F.col("dst").alias("at"), F.col("src").alias("neighbour"), "rel", F.lit("in").alias("way"))
    both = {"out": out, "in": into}.get(direction, out.unionByName(into))
    return nodes.join(both, nodes["node"] == both["at"]).select("node", "neighbour", "rel", "way")


def paths(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """start, hops, path (array of nodes) of all chains of 1 to depth edges that repeat no edge."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("to"))
    level = starts.select(F.col("node").alias("start"), F.col("node").alias("last"), F.array("node").alias("path"), F.array().cast("array<string>").alias("used"))
    found = None
    for hop in range(1, depth + 1):
        edge = F.concat_ws(">", F.col("last").cast("string"), F.col("to").cast("string"))
        level = level.join(step, F.col("last") == F.col("at")).where(~F.array_contains("used", edge)).select("start", F.col("to").alias("last"), F.concat("path", F.array("to")).alias("path"), F.concat("used", F.array(edge)).alias("used"))
        here = level.select("start", F.lit(hop).alias("hops"), "path")
        found = here if found is None else found.unionByName(here)
    return found


def closure(edges: DataFrame, starts: DataFrame, rounds: int | None = None) -> DataFrame:
    """start, node of all nodes that edges lead to from a start (column node), itself only by a cycle."""
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    frontier = checkpointed(starts.select(F.col("node").alias("start")).distinct().join(step, F.col("start") == F.col("at")).select("start", F.col("to").alias("node")).distinct())
    levels, n = [frontier], 1
    parts = max(1, frontier.rdd.getNumPartitions())
    while (rounds is None or n < rounds) and not frontier.isEmpty():
        reached = frontier.join(step, F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).distinct()
        frontier = checkpointed(reached.join(reduce(DataFrame.unionByName, levels), ["start", "node"], "left_anti"))
        # What is seen is the union of a few tables; it is written anew only when they are many.
        levels = [*levels, frontier] if len(levels) < MOST_LEVELS else [checkpointed(reduce(DataFrame.unionByName, [*levels, frontier]).coalesce(parts))]
        n += 1
    return reduce(DataFrame.unionByName, levels)


def with_least(edges: DataFrame) -> DataFrame:
    """u, v and the least v of each u. The aggregate has a row a node, so a node of very many edges is a skewed key of a join, which Spark splits."""
    least = edges.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("least"))
    return edges.join(least, edges["u"] == least["at"]).select("u", "v", "least")


def star(edges: DataFrame) -> DataFrame:
    """A large and a small star: every neighbour above a node is hung on the least around it, then every one below."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    above = with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
    below = with_least(above)
    rest = below.where(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return rest.unionByName(below.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) of every node that has an edge, by alternating large and small stars: rounds grow with the logarithm of the size, not with the diameter."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node IS NOT NULL").distinct()
    hung = checkpointed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    while True:
        hung = checkpointed(star(hung))
        # Two numbers reach the driver: enough to see that nothing changed.
        now = hung.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return nodes.join(hung, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
        seen = now


def ranks(edges: DataFrame) -> DataFrame:
    """node, depth: longest path into each node; nodes of cycles, and those behind them, are missing. Levels are peeled off."""
    left = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = checkpointed(left.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done, depth = None, 0
    while not nodes.isEmpty():
        blocked = left.select(F.col("dst").alias("node")).distinct()
        free = checkpointed(nodes.join(blocked, "node", "left_anti"))
        if free.isEmpty():
            break
        level = free.withColumn("depth", F.lit(depth))
        done = checkpointed(level if done is None else done.unionByName(level))
        left = checkpointed(left.join(free, left["src"] == free["node"], "left_anti"))
        nodes = checkpointed(nodes.join(free, "node", "left_anti"))
        depth += 1
    return done if done is not None else edges.sparkSession.createDataFrame([], f"node {edges.schema['src'].dataType.simpleString()}, depth int")


def relaxed_depth(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """node, depth after so many rounds of taking the deepest predecessor's depth plus one; cycles do no harm."""
    pairs = edges.select("src", "dst").where("src <> dst").distinct()
    depth = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("depth", F.lit(0))
    for _ in range(rounds):
        into = pairs.join(depth, F.col("src") == F.col("node")).groupBy("dst").agg(F.max(F.col("depth") + 1).alias("deeper"))
        depth = checkpointed(depth.join(into, F.col("node") == F.col("dst"), "left").select("node", F.greatest("depth", F.coalesce("deeper", "depth")).alias("depth")))
    return depth


def lineage_order(edges: DataFrame) -> DataFrame:
    """node, family (its least node), place in the family: the order in which a depth-first walk from the roots, children by name, meets the nodes.

    In a lineage without cycles that walk meets nodes by their least path of names, so paths are relaxed until none gets smaller; rounds grow with the
    depth. Nodes that no root reaches (behind cycles) come last, by name. Repeated links and loops count once and not at all.
    """
    links = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
    roots = links.select(F.col("src").alias("node")).distinct().join(links.select(F.col("dst").alias("node")), "node", "left_anti")
    known = checkpointed(roots.select("node", F.array("node").alias("path")))
    fresh = known
    while not fresh.isEmpty():
        longer = fresh.join(links, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = longer.groupBy("node").agg(F.min("path").alias("path"))
        fresh = checkpointed(best.join(known.withColumnRenamed("path", "old"), "node", "left").where("old IS NULL OR path < old").select("node", "path"))
        known = checkpointed(known.unionByName(fresh).groupBy("node").agg(F.min("path").alias("path")))
    place = F.row_number().over(W.partitionBy("family").orderBy(F.col("path").isNull(), "path", "node")) - 1
    return components(links).withColumnRenamed("component", "family").join(known, "node", "left").select("node", "family", place.alias("place"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: each end of each edge counts."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: Q of a partition (node, community) over undirected distinct edges without loops."""
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct()
    a, b = membership.select(F.col("node").alias("u"), F.col("community").alias("cu")), membership.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    both = pairs.join(a, "u").join(b, "v")
    inside = both.where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("inside"))
    degree = both.select(F.explode(F.array("cu", "cv")).alias("community")).groupBy("community").agg(F.count("*").alias("degree"))
    m = F.sum("degree") / 2
    per = degree.join(inside, "community", "left").select("degree", F.coalesce("inside", F.lit(0)).alias("inside"))
    return per.agg((F.sum("inside") / m - F.sum(F.col("degree") * F.col("degree")) / (4 * m * m)).alias("modularity"))


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community by label propagation: the label most frequent among neighbours, of equals the least; for large graphs."""
    both = checkpointed(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("dst") == F.col("node")).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
        labels = checkpointed(best.select(F.col("src").alias("node"), "community"))
    return labels


def greedy_communities(edges: DataFrame, most_edges: int = 200_000) -> DataFrame:
    """node, community (0 is the largest; equal sizes by least node) by greedy modularity merging within each connected component.

    Merging is sequential, so each component is one task; a component of more than most_edges edges is refused, and
    label_communities() is the way. The gain of a merge depends on all edges' number, which is counted first.
    """
    import pandas as pd

    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct()
    m = pairs.count()
    at = components(edges.where("src <> dst"))
    joined = checkpointed(pairs.join(at, F.col("u") == F.col("node")).select("component", "u", "v"))
    largest = joined.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > most_edges:
        raise ValueError(f"a component of {largest} edges: greedy merging takes {most_edges} at most; use label_communities()")
    kind = edges.schema["src"].dataType.simpleString()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        links: dict = {}
        for u, v in sorted(zip(rows["u"], rows["v"], strict=True)):
            links.setdefault(u, {})[v] = links.setdefault(v, {})[u] = 1.0 / (2 * m)
        share = {n: sum(x.values()) for n, x in links.items()}
        members = {n: [n] for n in sorted(links)}
        while True:
            best = max((2 * (w - share[a] * share[b]), a, b) for a in sorted(links) for b, w in links[a].items() if a < b) if any(links.values()) else (0, None, None)
            if best[0] <= 0:
                break
            _, a, b = best
            for c, w in links.pop(b).items():
                del links[c][b]
                if c != a:
                    links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
            share[a] += share.pop(b)
            members[a] += members.pop(b)
        return pd.DataFrame([(n, min(group), len(group)) for group in members.values() for n in group], columns=["node", "least", "size"])

    found = joined.groupBy("component").applyInPandas(merge, f"node {kind}, least {kind}, size long")
    order = found.select("least", "size").distinct()
    ranked = order.withColumn("community", F.row_number().over(W.orderBy(F.desc("size"), "least")) - 1)
    return found.join(ranked.select("least", "community"), "least").select("node", "community")


def ring_layout(nodes: DataFrame, community: Column, order: Column, radius: float = 100.0, golden: float = 2.399963229728653) -> DataFrame:
    """nodes with x and y: communities on a ring, their nodes on a spiral by the golden angle around it."""
    ranked = nodes.withColumn("community", community).withColumn("at", F.row_number().over(W.partitionBy("community").orderBy(order)) - 1)
    count = ranked.agg(F.max("community").alias("last"))
    centre = 2 * 3.141592653589793 * F.col("community") / (F.col("last") + 1)
    spread = F.sqrt(F.col("at") + F.lit(0.5)) * 4
    return ranked.crossJoin(F.broadcast(count)).select(*nodes.columns, (F.cos(centre) * radius + F.cos(F.col("at") * golden) * spread).alias("x"), (F.sin(centre) * radius + F.sin(F.col("at") * golden) * spread).alias("y"))


def pair_weights(edges: DataFrame) -> DataFrame:
    """a, b (a < b), weight: parallel edges between two nodes, either way; loops do not count."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"))


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose two ends are among the nodes (column node)."""
    n = nodes.select("node").distinct()
    return edges.join(n, edges["src"] == n["node"], "left_semi").join(n, edges["dst"] == n["node"], "left_semi")

"""Exact top-k search by a Voronoi kNN join, for the largest integer inner products.

Vectors are quantised to integers, floor(scale * x). Some of them, taken by hash, are pivots; every vector
belongs to the cell of its nearest pivot. Summaries of the cells (count, and the distances of the vectors
nearest to the pivot) give each query a score that at least k candidates reach: a vector at distance d
from pivot p scores q.p - |q| d at least and q.p + |q| d at most. So a query needs of a cell only
the vectors farther from its pivot than (reached - q.p) / |q|. The least such distance over the queries of one cell (a
query group) is the group's bound for the other cell; only vectors beyond it are replicated to the group, and
each group is solved locally by blocked matrix products. Cells with few queries are joined to groups of up to QUERY_BLOCK queries
(a group's bound is the least of its cells'), so a vector is sent at most once for every QUERY_BLOCK queries. The bounds are on exact integers with room for
rounding, so the result is exact whatever the pivots are.

Copies are collapsed first: of candidates with equal vectors, only the k + 1 smallest ids can be among any
query's best, and queries with equal vectors are solved once. Groups are solved in blocks of bounded
size: at most BLOCK candidates by QUERY_BLOCK queries a task; each block returns its best k + 1, and the
best of these are the result. What reaches the driver are the pivots, one summary a cell, and one
bound a pair of cells.

Nulls and odd rows: vectors that are null, empty or hold null or non-finite components take no part,
neither as queries nor as candidates; nor do queries with a null id. Vectors of another length than
the query's are not its candidates. Components beyond 2**59 in size after scaling are clipped
there, as their products leave Spark's widest numbers; scores are exact integers in the ranking, and shown within 64 bits. Ties go to the smaller id. Of rows that repeat an
id, the one whose quantised vector is least as bytes takes part. An empty table gives an empty result; columns
other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, table

SCALE, K = 256, 5
#: Pivots of each vector length: one for VECTORS_A_PIVOT vectors, but within these bounds, so what the driver and the tasks hold of them is bounded.
PIVOTS, MOST_PIVOTS, VECTORS_A_PIVOT = 48, 512, 16_384
BLOCK, QUERY_BLOCK = 16384, 2048
#: Copies of one vector are first thinned within so many parts, so that no task sees all of a large group.
SALTS = 64
CLIP = 1 << 59
SCORE = pa.decimal128(38, 0)


def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, vector (list of double) -> id, v (little-endian 64-bit integers) of the rows that take part."""
    for rows in batches:
        ids, out = [], []
        for i, x in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            if i is None or not x or any(c is None for c in x):
                continue
            values = np.asarray(x, dtype=np.float64)
            if np.isfinite(values).all():
                with np.errstate(over="ignore"):
                    ids.append(i)
                    out.append(np.clip(np.floor(SCALE * values), -CLIP, CLIP).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])


def matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<i8").reshape(-1, dim)


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum fits its 53 bits, as Python's integers elsewhere."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    return queries.astype(object) @ data.astype(object).T


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, one pivot at a time."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def walk(centres: np.ndarray) -> list[int]:
    """All pivots, each followed by the nearest of those that are left."""
    left, out = list(range(len(centres))), []
    while left:
        at = int(((centres[left] - centres[out[-1]]) ** 2).sum(axis=1).argmin()) if out else 0
        out.append(left.pop(at))
    return out


def thinned(vectors: DataFrame, keep: int) -> DataFrame:
    """Of each distinct vector, the `keep` smallest ids: v, ids."""
    salted = W.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy("id")
    whole = W.partitionBy("v").orderBy("id")
    few = vectors.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= keep)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def search(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = K, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k best candidates among all other ids. is_query is over a column named id."""
    spark = df.sparkSession
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(quantise, "id long, v binary")
    vectors = checkpointed(vectors.groupBy("id").agg(F.min("v").alias("v")))
    data = checkpointed(thinned(vectors, k + 1).withColumn("dim", (F.length("v") / 8).cast("int")))
    asked = vectors.where(is_query)
    asked_vectors = checkpointed(asked.groupBy("v").agg(F.min("id").alias("qid")).withColumn("dim", (F.length("v") / 8).cast("int")))
    dims = sorted(r.dim for r in asked_vectors.select("dim").distinct().collect())
    found = [_of_length(spark, data.where(F.col("dim") == d), asked_vectors.where(F.col("dim") == d), d, k, pivots) for d in dims]
    best = spark.createDataFrame([], "v binary, qid long, id long, score decimal(38,0)")
    for part in found:
        best = best.unionByName(part)
    best = checkpointed(best)
    # Every query of the vector: its own id is no candidate.
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    shown = F.greatest(F.least("score", F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long")
    pairs = asked.select("v", F.col("id").alias("query_id")).join(best.select("v", "id", "score"), "v").where(F.col("id") != F.col("query_id"))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", shown.alias("score"))


def _of_length(spark: SparkSession, data: DataFrame, asked: DataFrame, dim: int, k: int, n_pivots: int | None) -> DataFrame:
    """Each distinct query vector's k + 1 best candidates: v, qid, id, score."""
    n_pivots = n_pivots or min(MOST_PIVOTS, max(PIVOTS, data.count() // VECTORS_A_PIVOT))
    chosen = [r.v for r in data.orderBy(F.xxhash64("v"), "v").limit(n_pivots).select("v").collect()]
    if not chosen:
        return spark.createDataFrame([], "v binary, qid long, id long, score decimal(38,0)")
    centres = matrix(chosen, dim).astype(np.float64)
    cells = len(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                away = distances(matrix(rows.column("v").to_pylist(), dim).astype(np.float64), centres)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], names=[*rows.schema.names, "cell", "away"])

    near = checkpointed(data.select("v", "ids").mapInArrow(assign, "v binary, ids array<long>, cell int, away double"))
    groups = checkpointed(asked.select("v", "qid").mapInArrow(assign, "v binary, qid long, cell int, away double"))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 least distances of each cell in this partition, each as often as its vector has ids."""
        least: dict[int, np.ndarray] = {}
        rows_in: dict[int, int] = {}
        for rows in batches:
            cell, away = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            times = rows.column(2).to_numpy()
            for c in np.unique(cell):
                here = np.repeat(away[cell == c], times[cell == c])
                least[c] = np.sort(np.concatenate([least.get(c, here[:0]), here]))[: k + 1]
                rows_in[c] = rows_in.get(c, 0) + int((cell == c).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(c) for c in least], pa.int32()), pa.array([x.tolist() for x in least.values()], pa.list_(pa.float64())), pa.array([rows_in[c] for c in least], pa.int64())], names=["cell", "least", "n"]
        )

    parts = near.select("cell", "away", F.size("ids").alias("times")).mapInArrow(summarise, "cell int, least array<double>, n long")
    summaries = parts.groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k + 1).alias("least"), F.sum("n").alias("n")).collect()
    in_cell = {r.cell: r.n for r in summaries}
    total = sum(in_cell.values())
    reach = np.full((cells, k + 1), np.inf)
    for r in summaries:
        reach[r.cell, : len(r.least)] = r.least

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For this partition's queries: by query cell and data cell, the least distance from the pivot that a needed vector can have."""
        bounds = np.full((cells, cells), np.inf)
        counts = np.zeros(cells, dtype=np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            q = matrix(rows.column("v").to_pylist(), dim).astype(np.float64)
            cell = rows.column("cell").to_numpy()
            norm = np.sqrt((q * q).sum(axis=1))
            centre = q @ centres.T
            # k + 1 candidates (the query itself may be one) score at least this; all cells' floors compete.
            floors = (centre[:, :, None] - norm[:, None, None] * reach[None]).reshape(len(q), -1)
            kept = floors.shape[1] - (k + 1)
            reached = np.partition(floors, kept, axis=1)[:, kept]
            room = 1e-9 * (np.abs(centre) + norm[:, None] * np.abs(centres).max(initial=1) * dim + 1) + 1e-6
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(norm[:, None] > 0, (reached[:, None] - centre - room) / norm[:, None], -np.inf)
            np.minimum.at(bounds, cell, need)
            np.add.at(counts, cell, 1)
        g, c = np.nonzero(bounds < np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(bounds[g, c]), pa.array(counts[g])], names=["g", "c", "need", "n"])

    wanted = groups.select("v", "cell").mapInArrow(bound, "g int, c int, need double, n long").groupBy("g", "c").agg(F.min("need").alias("need"), F.sum("n").alias("n")).collect()
    asks = np.zeros(cells, dtype=np.int64)
    for r in wanted:
        asks[r.g] = r.n
    # Cells in the order of a walk from pivot to nearest pivot, joined while their queries fit a block.
    group_of, query_blocks = np.zeros(cells, dtype=np.int64), []
    held = QUERY_BLOCK + 1
    for c in walk(centres):
        if held + asks[c] > QUERY_BLOCK:
            query_blocks.append(0)
            held = 0
        held += asks[c]
        group_of[c], query_blocks[-1] = len(query_blocks) - 1, max(1, -(-held // QUERY_BLOCK))
    query_blocks = np.array(query_blocks)
    need = np.full((len(query_blocks), cells), np.inf)
    for r in wanted:
        need[group_of[r.g], r.c] = min(need[group_of[r.g], r.c], r.need)
    data_blocks = max(1, -(-total // BLOCK))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the groups whose bound it passes, into one block of candidates of each of their blocks of queries."""
        for rows in batches:
            if not rows.num_rows:
                continue
            block = rows.column("spread").to_numpy()
            row, group = np.nonzero(rows.column("away").to_numpy()[:, None] * (1 + 1e-12) + 1e-9 >= need[:, rows.column("cell").to_numpy()].T)
            times = query_blocks[group]
            row, group = np.repeat(row, times), np.repeat(group, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            kept = rows.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(block[row].astype(np.int32)), kept.column("v"), kept.column("ids"), pa.nulls(len(row), pa.int64())],
                names=["g", "part", "block", "v", "ids", "qid"],
            )

    blocks = "g int, part int, block int, v binary, ids array<long>, qid long"
    spread = near.select("v", "ids", "cell", "away", F.pmod(F.xxhash64("v"), F.lit(data_blocks)).cast("int").alias("spread"))
    sent = spread.mapInArrow(replicate, blocks)
    group = F.element_at(F.array(*[F.lit(int(g)) for g in group_of]), F.col("cell") + 1)
    parts_of = F.element_at(F.array(*[F.lit(int(n)) for n in query_blocks]), F.col("g") + 1)
    asking = groups.withColumn("g", group.cast("int")).select(
        "g", F.pmod(F.xxhash64("v"), parts_of).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(int(data_blocks) - 1))).alias("block"), "v", F.lit(None).cast("array<long>").alias("ids"), "qid"
    )

    def solve(rows: pa.Table) -> pa.Table:
        asks = np.array(rows.column("qid").is_valid())
        q_v, q_id = rows.column("v").filter(pa.array(asks)).to_pylist(), rows.column("qid").drop_null().to_pylist()
        x_v, x_ids = rows.column("v").filter(pa.array(~asks)).to_pylist(), rows.column("ids").filter(pa.array(~asks)).to_pylist()
        out: tuple[list, list, list, list] = ([], [], [], [])
        if q_v and x_v:
            first = np.array([i[0] for i in x_ids])
            by_id = np.argsort(first, kind="stable")
            data = matrix(x_v, dim)[by_id]
            for at in range(0, len(q_v), 256):
                scores = products(matrix(q_v[at : at + 256], dim), data)
                kept = min(k + 1, len(data))
                for j, row in enumerate(scores):
                    least = np.partition(row, len(row) - kept)[len(row) - kept] if row.dtype != object else sorted(row)[len(row) - kept]
                    top = np.flatnonzero(row >= least)
                    top = np.array(sorted(top.tolist(), key=lambda t: (-row[t], t))[:kept])
                    ids = sorted((-int(row[t]), i) for t in top for i in x_ids[by_id[t]])[: k + 1]
                    for minus, i in ids:
                        for column, value in zip(out, (q_v[at + j], q_id[at + j], i, -minus), strict=True):
                            column.append(value)
        return pa.table({"v": pa.array(out[0], pa.binary()), "qid": pa.array(out[1], pa.int64()), "id": pa.array(out[2], pa.int64()), "score": pa.array([Decimal(s) for s in out[3]], SCORE)})

    local = sent.unionByName(asking).groupBy("g", "part", "block").applyInArrow(solve, "v binary, qid long, id long, score decimal(38,0)")
    order = W.partitionBy("v").orderBy(F.desc("score"), "id")
    return local.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op8_voronoi_knn": op8_voronoi_knn}
ORACLE = {"op8_voronoi_knn": ORACLE_SQL}

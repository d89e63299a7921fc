import math
import random

from pyspark.sql import functions as F

from quillgraph.llm import op8_voronoi_knn as op


def brute_force(data, is_query, k):
    ints = {i: [math.floor(256 * c) for c in v] for i, v in data.items()}
    want = []
    for q in filter(is_query, ints):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], w, strict=True)), i) for i, w in ints.items() if i != q)[:k]
        want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
    return sorted(want)


def found(spark, data, k, **more):
    df = spark.createDataFrame(list(data.items()), "k long, e array<double>")
    return sorted((x.query_id, x["rank"], x.id, x.score) for x in op.search(df, "k", "e", F.col("id") % 10 == 0, k=k, **more).collect())


def test_large_components_are_ranked_exactly(spark):
    """Components of 1e8, whose scores leave 64 bits or nearly do, beside small ones."""
    r = random.Random(4)
    data = {i: [r.choice([1, -1]) * 10 ** r.uniform(0, 8) for _ in range(4)] for i in range(120)}
    data |= {1000 + i: [1e8 + i, 1e8, 1e8 - i, 1e8] for i in range(10)}
    assert found(spark, data, 4, pivots=6) == brute_force(data, lambda i: i % 10 == 0, 4)


def test_few_queries_are_one_group(spark, monkeypatch):
    """With all queries in one block a vector goes to the solver once; with tiny blocks the result is the same."""
    r = random.Random(9)
    data = {i: [r.gauss(0, 1) for _ in range(6)] for i in range(500)}
    want = brute_force(data, lambda i: i % 10 == 0, 5)
    assert found(spark, data, 5, pivots=12) == want
    monkeypatch.setattr(op, "QUERY_BLOCK", 7)
    assert found(spark, data, 5, pivots=12) == want


def test_walk_visits_every_pivot_once():
    import numpy as np

    assert sorted(op.walk(np.random.default_rng(0).normal(size=(30, 4)))) == list(range(30))

"""The ledger where several works have the id that a reference states."""

import threading

import duckdb
from pyspark.sql import functions as F

from quillgraph.operators import reading as R
from quillgraph.plans import registry


def test_parts_that_share_an_id(spark, tmp_path):
    """Part keys 300,000 apart have one arXiv id; 6 and 300018 and others among them have no known title."""
    keys = [k for b in (3, 6, 9, 12, 18, 21) for k in (b, b + 300_000, b + 600_000, b + 900_000)] + [4, 300_004, 5, 300_005, 7, 15]
    parts = [(p, f"name{p % 7}", "T", "b", 1, 1.0) for p in keys]
    assert any(p % 7 == 0 and p % 3 == 0 and p > 300_000 for p in keys) and any(p % 7 == 0 and p % 3 == 0 and p < 300_000 for p in keys)
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, p) for o in (2, 3, 4, 9, 300_003) for p in keys], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o,) for o in (2, 3, 4, 8, 9, 300_003)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    rel = con.execute(registry.ORACLE["t11_ledger"])
    df = registry.QUERIES["t11_ledger"](spark, str(tmp_path)).select(*[c[0] for c in rel.description])
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rel.fetchall()))


def test_which_of_several_works(spark):
    raws = ["A. Old gears. arXiv:2401.00001", "A. Old gears and new ones. arXiv:2401.00001", "A. Unknown. ARXIV 2401.00001v2", "A. Old gears. doi:10.1000/x", "B. doi:10.1000/x", "A. Old gears. doi:10.1000/y", "Old gears arXiv:2401.00003", "Clocks arXiv:2401.00001"]
    works = spark.createDataFrame([("w",)], "citing string")
    entries = spark.createDataFrame([("w", i, r) for i, r in enumerate(raws, 1)], "citing string, pos int, raw string")
    titles = spark.createDataFrame([("p1", "Of cars"), ("p2", "Old Gears"), ("p2", "Other words here"), ("p3", "Old gears and new ones"), ("p4", None), ("p5", "Clocks"), ("p6", "Old gears"), ("p7", "Of boats")], "paper_id string, title string")
    ids = [("arXiv:2401.00001", p) for p in ("p2", "p3", "p4", "p5")] + [("doi:10.1000/X", p) for p in ("p3", "p2", "p6")] + [("doi:10.1000/y", "p3"), ("arxiv:2401.00003", "p7"), ("arxiv:2401.00003", "p1")]
    got = R.ledger(works, entries, titles, spark.createDataFrame(ids + ids[:3], "alias string, paper_id string")).orderBy("reference_id").collect()
    assert [r.target for r in got] == ["p2", "p3", "p4", "p2", "p2", "p3", "p1", "p4"]
    assert {(r.state, r.method) for r in got} == {("resolved_in_corpus", "stated_id")}


def test_one_id_of_many_works(spark):
    """20,000 works and as many references have one id; no pairs but those that hold."""
    n = F.format_string("%07d", F.col("id"))
    rows = spark.range(20_000)
    entries = rows.select(F.lit(-1).cast("long").alias("citing"), F.col("id").alias("pos"), F.concat(F.lit("A. Gears number "), n, F.lit(". arXiv:2401.00001")).alias("raw"))
    titles = rows.select(F.col("id").alias("paper_id"), F.concat(F.lit("Gears number "), n).alias("title"))
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = R.ledger(entries.select("citing").distinct(), entries, titles, rows.select(F.lit("arxiv:2401.00001").alias("alias"), F.col("id").alias("paper_id")))
        assert got.where("target = cast(substring_index(reference_id, 'ref', -1) AS long)").count() == got.count() == 20_000
    finally:
        late.cancel()

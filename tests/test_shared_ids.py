import duckdb

from quillgraph.operators import matching as M
from quillgraph.plans import registry


def shared_ids(spark, folder):
    """Tables in which two parts of one order share an arXiv id."""
    parts = [(p, f"name{p % 7}", "T", "b", 1, 1.0) for p in (0, 1, 2, 300000, 300001)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    items = [(o, p) for o in (2, 4, 5) for p in (0, 1, 2, 300000, 300001)] + [(6, 300000), (8, 0)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


def test_parts_that_share_an_id(spark, tmp_path):
    con = shared_ids(spark, str(tmp_path))
    for name in ("j24_backfill_edges", "j35_matching_entry", "t09_body_markers"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        rel = con.execute(registry.ORACLE[name])
        want = sorted(rel.fetchall())
        assert sorted(tuple(r) for r in df.select(*[c[0] for c in rel.description]).collect()) == want, name


def test_stated_works_without_titles(spark):
    refs = spark.createDataFrame([(1, "A. A title here. arXiv:2401.00001"), (2, "B. arXiv:2401.00001"), (3, "C."), (4, None)], "id long, raw string")
    held = spark.createDataFrame([(10, "A title here", "arxiv:2401.00001"), (11, "Another", "arxiv:2401.00001")], "dst long, title string, stated string")
    assert {tuple(r) for r in M.stated_works(refs, held).collect()} == {(1, 10), (2, 10), (2, 11)}

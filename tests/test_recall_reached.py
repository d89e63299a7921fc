import math

from pyspark.sql import functions as F

from quillgraph.functions import stats as S
from quillgraph.plans import registry


def survival(found, screened, total):
    if found <= 0:
        return 1.0
    relevant = min(total, math.ceil(found / 0.95))
    return sum(math.comb(relevant, k) * math.comb(total - relevant, screened - k) for k in range(found, min(screened, relevant) + 1)) / math.comb(total, screened)


def test_survival(spark):
    rows = [(f, s, t) for t in (1, 10, 40) for s in range(0, t + 1, 3) for f in range(0, min(s, t) + 1)] + [(20, 50, 200), (39, 60, 500)]
    df = spark.createDataFrame(rows, "f int, s int, t int")
    for r in df.select("*", S.stop_p_value(F.col("f"), F.col("s"), F.col("t")).alias("p"), S.recall_reached(F.col("f"), F.col("s"), F.col("t")).alias("reached")).collect():
        want = survival(r.f, r.s, r.t)
        assert math.isclose(r.p, want, rel_tol=1e-9, abs_tol=1e-12) and r.reached == (want < 0.05), r


def test_every_customer_has_a_row(spark):
    d = "/root/testdata/sf0.001"
    got = registry.QUERIES["m02_recall_reached"](spark, d).collect()
    assert sorted(r.id for r in got) == sorted(r.c_custkey for r in spark.read.parquet(f"{d}/customer.parquet").collect())
    assert all(math.isclose(r.p, survival(3 + r.id % 5, 40 + r.id % 30, 200), abs_tol=1e-8) for r in got)

import random
from collections import Counter

from pyspark.sql import functions as F

from quillgraph.operators import matching as M

RECORD = "id long, doi string, arxiv string, words array<string>"


def test_gold_matches(spark):
    gold = spark.createDataFrame([(1, "d", None, ["a"]), (2, None, "x", []), (3, None, None, "a b c d e f g h i".split()), (4, None, None, None)], RECORD)
    works = spark.createDataFrame([(10, "d", None, ["z"]), (9, "d", None, ["z"]), (11, None, "x", ["q"]), (12, None, None, "a b c d e f g h i j".split()), (13, None, None, None)], RECORD)
    assert {tuple(r) for r in M.gold_matches(gold, works).collect()} == {(1, 9, 1.0), (2, 11, 1.0), (3, 12, 0.9)}
    assert M.gold_matches(gold.limit(0), works).count() == 0 and M.gold_matches(gold, works.limit(0)).count() == 0


def test_titles(spark):
    works = spark.createDataFrame([(1, None, None, "a b c d e f g".split()), (2, "d", None, "a b".split()), (3, None, None, None)], RECORD)
    asked = spark.createDataFrame([(5, None, None, "a b c d e f g".split()), (6, "d", None, "a b c d e f g".split()), (7, None, None, "a b q".split())], RECORD)
    assert {tuple(r) for r in M.title_twins(asked, works).collect()} == {(5, 1), (6, 1)}
    assert {tuple(r) for r in M.contained_titles(asked, works).collect()} == {(5, 1), (6, 2), (7, 2)}
    assert {(r.a_id, r.b_id) for r in M.nearest(asked.select("id", "words"), works.select("id", "words")).collect()} == {(5, 1), (6, 1), (7, 2)}


def test_as_of(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9), (4, None, 9), (5, "u", 5)], "n long, who string, at long")
    right = spark.createDataFrame([("u", 2, 7.0), ("u", 5, 8.0), ("u", 5, 6.0), ("u", 6, 9.0), (None, 1, 4.0)], "who string, at long, v double")
    got = {r.n: r.v for r in M.as_of(left, right, "who", "at", "v").collect()}
    # Keys that are null are one key here.
    assert got == {1: 8.0, 2: None, 3: None, 4: 4.0, 5: 8.0}


def test_greedy_assignment(spark):
    r = random.Random(1)
    rows = [(c, l, r.randint(0, 4)) for c in range(7) for l in range(5)]
    taken, want = (set(), set()), set()
    for score, c, l in sorted(((s, c, l) for c, l, s in rows), reverse=True):
        if c not in taken[0] and l not in taken[1]:
            want.add((c, l))
            taken[0].add(c)
            taken[1].add(l)
    df = spark.createDataFrame(rows, "ci long, li long, score long")
    assert {tuple(x) for x in M.greedy_assignment(df).collect()} == want
    assert M.greedy_assignment(df.limit(0)).count() == 0


def test_first_owner_and_channels(spark):
    rows = [(1, 2, 0), (2, 1, 0), (3, 3, 0), (5, 4, 1), (5, 4, 0), (4, 5, 2), (6, None, 0)]
    assert {tuple(x) for x in M.first_owner(spark.createDataFrame(rows, "owner long, other long, rank int")).collect()} == {(1, 2), (4, 5)}
    one, two = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert {tuple(x) for x in M.first_of([one, two], "k").collect()} == {(1, 0), (2, 0), (3, 1)}


def test_read_only_and_urls(spark):
    rows = [("MATCH (n) RETURN n", True), ("match (n) set n.x = 1", False), ("RETURN 'please delete it'", True), ("", False), (None, False), ("RETURN settings", True)]
    got = spark.createDataFrame(rows, "q string, want boolean").select("want", M.is_read_only(F.col("q")).alias("ok")).collect()
    assert all(r.want == r.ok for r in got)
    rows = [("arxiv:1", None, None), ("openalex:W2", "", ""), ("x", None, "10.1/2"), ("x", None, "http://d"), ("x", "u", "10.1/2"), ("x", None, None), (None, None, None)]
    got = [r.u for r in spark.createDataFrame(rows, "i string, u string, d string").select(M.work_url(F.col("i"), F.col("u"), F.col("d")).alias("u")).collect()]
    assert got == ["https://arxiv.org/abs/1", "https://openalex.org/W2", "https://doi.org/10.1/2", "http://d", "u", "", ""]


def test_scrubbed(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("embedding"), F.array(F.struct(F.lit(2).alias("x"), F.lit(3).alias("embedding"))).alias("in")).alias("s"), F.lit(4).alias("embedding"), F.lit(5).alias("y"))
    out = M.scrubbed(df)
    assert out.columns == ["s", "y"] and out.first().s.asDict(recursive=True) == {"in": [{"x": 2}]}


def test_approve(spark):
    waiting = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "pos int, title string")
    rows, log = M.approve(waiting, (1,), "v2", "2024-05-01")
    assert {(r.title, r.version, r.approved_on) for r in rows.collect()} == {("a", "v2", "2024-05-01"), ("c", "v2", "2024-05-01")}
    assert tuple(log.first()) == ("v2", "2024-05-01", 2, 1)
    assert M.approve(waiting.limit(0), (), "v", "d")[0].count() == 0


def test_hashed_embedding(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "id int, words array<string>")
    rows = M.hashed_embedding(df, "id", "words", 16).collect()
    assert {r.id for r in rows} == {1} and abs(sum(r.weight**2 for r in rows) - 1) < 1e-12


def test_labels_and_summaries(spark):
    rows = [("not_found", 2, 0), ("x", 0, 0), ("x", 1, 2), ("x", 2, 1), ("established", 1, 1), ("x", 1, 1)]
    got = [r.l for r in spark.createDataFrame(rows, "v string, s int, c int").select(M.claim_label(F.col("v"), F.col("s"), F.col("c")).alias("l")).collect()]
    assert Counter(got) == {"NOINFO": 3, "CONTRADICT": 1, "SUPPORT": 2} and got[0] == "NOINFO"
    got = spark.createDataFrame([("s", "m", "r", "p"), ("", "m", None, "p")], "s string, m string, r string, p string").select(M.summary(*map(F.col, "smrp")).alias("x")).collect()
    assert [r.x for r in got] == ["s", "m →  (for: p)"]

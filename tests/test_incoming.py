"""Links of returned records: against the predicate pair by pair, and many records of one title that many works have."""

import random
import threading

from pyspark.sql import functions as F

from quillgraph.functions import identity as I
from quillgraph.operators import resolve as R

FIELDS = "id string, title string, authors array<string>, year int, url string, doi string"


def rows(r, n, tag):
    words = "alpha beta gamma delta epsilon zeta eta theta iota".split()
    out = []
    for i in range(n):
        title = r.choice([None, "short", "A Title Of Some Work", "Another title", " ".join(r.sample(words[:8], r.randint(6, 8))), " ".join(words[: r.randint(6, 9)])])
        authors = r.choice([None, [], ["Ann Lee"], ["Bo Chen", "A. Lee"]])
        doi = r.choice([None, None, f"10.1000/{r.randint(0, 12)}", f"10.1000/{tag}{i}"])
        url = r.choice([None, None, f"arxiv.org/abs/2401.{r.randint(0, 12):05}", f"arxiv.org/abs/2402.{i:05}"])
        out.append((i, r.choice([f"{tag}{i}", None]), title, authors, r.choice([None, 2000, 2003]), url, doi))
    return out


def test_against_the_predicate(spark):
    links = 0
    for seed in range(4):
        r = random.Random(seed)
        held = spark.createDataFrame(rows(r, (4, 8, 14, 40)[seed], "h"), f"pos long, {FIELDS}")
        back = spark.createDataFrame([(*x, r.randint(0, 8)) for x in rows(r, 70, "b")], f"pos long, {FIELDS}, target long")
        seen = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
        side = lambda d, tag: R.described(d).select(F.col("pos").alias(tag), F.struct(*R.FIELDS).alias(f"r{tag}"))
        pairs = side(back, "a").crossJoin(side(held, "b")).where(I.same_work(*({n: F.col(f"r{t}.{n}") for n in R.FIELDS} for t in "ab"))).select("a", "b").collect()
        of = {}
        for a, b in pairs:
            of.setdefault(a, set()).add(b)
        want = set()
        for x in back.collect():
            others = of.get(x.pos, set()) - {x.target}
            if len(others) == 1:
                want.add((*others, x.target))
        want -= {(1, 2), (3, 4)}
        for most in (100_000, 0):
            got = [tuple(x) for x in R.incoming(held, back, seen, most).collect()]
            assert sorted(got) == sorted(want)
        links += len(want)
    assert links > 20


def test_many_records_of_a_title_of_many_works(spark):
    """30,000 works of one title with a DOI or none, and as many records of it with ids of their own: no pairs."""
    none = {"authors": F.lit(None).cast("array<string>"), "year": F.lit(None).cast("int")}
    i = F.col("id")
    name = lambda tag: F.concat(F.lit(tag), i.cast("string"))
    held = spark.range(30_000).select(i.alias("pos"), name("h").alias("id"), F.lit("One title of all works").alias("title"), F.when(i % 2 == 0, name("10.1000/")).alias("doi"), F.lit(None).cast("string").alias("url")).withColumns(none)
    url = F.concat(F.lit("arxiv.org/abs/2401."), F.lpad(i.cast("string"), 5, "0"))
    back = spark.range(30_000).select(i.alias("pos"), name("b").alias("id"), F.lit("One title of all works").alias("title"), F.when(i % 3 == 0, name("10.1000/")).alias("doi"), url.alias("url"), (i + 1).alias("target")).withColumns(none)
    # Each record's arXiv id is its own, so all match the thousands of works without an arXiv id.
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        assert R.incoming(held, back, spark.createDataFrame([], "src long, dst long")).count() == 0
        known = back.where("pos % 3 = 0 AND pos % 2 = 0").withColumn("title", F.lit("A title of no held work"))
        assert R.incoming(held, known, spark.createDataFrame([], "src long, dst long")).count() == 5_000
    finally:
        late.cancel()

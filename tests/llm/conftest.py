import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(r, n):
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(2, 8))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of small tables with nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    top = str(tmp_path_factory.mktemp("odd"))
    r = random.Random(5)
    base = words(r, 400)
    near = [w if i % 61 else "changed" for i, w in enumerate(base)]
    half = base[:200] + words(r, 200)
    texts = [
        None, "", "   \n\t ", "one", "One", "two words", "four words in all", "five words are one shingle", " ".join(base), " ".join(base), " ".join(near).upper(), " ".join(half),
        "x" * 5000, " ".join(words(r, 30_000)), "é ß 中文 😀 ñandú", "stupid idiot you moron " * 3, "a\u00a0b\u0085c", "naïve\x1cfoo \x00bar",
    ]
    rows = [(i, t, [None, "en", "de", "xx"][i % 4], [None, "src1", "src2", "src1"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[5], rows[0]]
    rows += [(100 + i, " ".join(words(r, 40) + (["moron", "scum"] if i % 5 == 0 else [])), "en", "src3", 200) for i in range(80)]
    extra = "1 AS id, 'x' AS cls, 2 AS n, 'y' AS hash, 3 AS size, 'z' AS url, 4.5 AS score, 'k' AS key, 9 AS label, 'q' AS rule, 7 AS copies, 'w' AS host, 5 AS dropped_id"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra.split(", ")).write.parquet(f"{top}/documents.parquet")
    labels = [(100 + i, 1, int(i % 5 == 0)) for i in range(80)] + [(None, 1, 1), (101, None, None), (102, 1, 0), (5, 0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'t' AS text", "0 AS turn").write.parquet(f"{top}/labels.parquet")
    vectors = [(i, [float(r.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(0, 320)]
    vectors += [(1000 + i, [1.0, 1.0, 1.0, 1.0], 0) for i in range(60)]
    vectors += [(2000, None, 0), (2001, [], 0), (2050, [1.0, None, 0.0, 0.0], 0), (2051, [float("nan"), 0.0, 0.0, 0.0], 0), (2052, [float("inf"), 0.0, 0.0, 0.0], 0), (2100, [1.0, 2.0], 0), (2101, [2.0, 1.0], 0), (None, [1.0, 1.0, 1.0, 1.0], None), (50, [0.5, 0.5, 0.5, 0.5], 1), (50, [0.5, 0.5, 0.5, 0.5], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "'v' AS v", "2 AS cell", "3 AS score").write.parquet(f"{top}/embeddings.parquet")
    pages = [
        (0, None, None), (1, "", ""), (2, "no scheme", "<p>plain"), (3, "http://A.Example.NET/en/x?q=1#f", "<html lang=de><nav>menu</nav><article><h1>T</h1><p>a &lt;b&gt; c</p></article>"),
        (4, "http://example.net/de/", "<article><p>x"), (5, "https://www.example.org/fr/1", "<main>y<form>no</form></main>"), (6, "http://notnet", "<div><p>" + "word " * 50 + "</div><div class='ad'>" + "spam " * 9 + "</div>"),
        (7, "http://x.com/free?pills=1", "<script>var a='<p>'</script><article>q</article>"), (8, "http://x.com/free-range", "&amp; &nope &am"), (9, "http://casinos.com/", "<!-- <article> --> t"),
        (10, "HTTP://casino.com", "<p>unclosed <b>bold <i>it"), (None, "http://sub.example.com/de/9", "<article>z</article>"), (4, "http://example.net/de/", "<article><p>x"), (11, "http://net/", "<" * 50), (12, "a://b://c.net/x", "<article>" + "w " * 20000),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'h' AS host", "'t' AS text", "'r' AS rest", "'p' AS path").write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    """The same tables without rows."""
    top = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{top}/{name}.parquet")
    return top

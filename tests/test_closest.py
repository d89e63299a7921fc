import random

import pytest

from quillgraph.operators import matching as M
from quillgraph.operators import retrieval as R


@pytest.mark.parametrize("least,longest", [(0.2, 9), (0.6, 9), (0.6, 30)])
def test_closest_against_brute_force(spark, least, longest):
    r = random.Random(longest)
    draw = lambda: ["all", "size", *r.sample([f"w{i}" for i in range(9 if longest < 10 else 33)], r.randint(0, longest - 2))]
    works = [(i, draw()) for i in range(150)] + [(500, None), (501, [])]
    asked = [w for w in works if w[0] % 3 == 0] + [(900, draw()), (901, []), (902, None)]
    a, b = spark.createDataFrame(asked, "id long, words array<string>"), spark.createDataFrame(works, "id long, words array<string>")
    alone = lambda ranked, apart, score: {
        (i, *best[0][1:]) for i, x in asked if x
        if (best := sorted((-score(x, y) if ranked else 0, j) for j, y in works if y and set(x) & set(y) and score(x, y) >= least and not (apart and i == j)))
    }
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    for ranked, apart in ((True, False), (True, True), (False, True)):
        got = {tuple(x)[:2] for x in R.closest(a, b, R.by_jaccard, lambda s: s >= least, ranked, apart).collect()}
        assert got == alone(ranked, apart, jaccard)
    shorter = lambda x, y: len(set(x) & set(y)) / min(len(set(x)), len(set(y)))
    assert {tuple(x)[:2] for x in R.closest(a, b, M._of_shorter, lambda s: s >= least).collect()} == alone(True, False, shorter)


def test_words_that_all_titles_have(spark):
    """20,000 titles share two words: by single words these were some 80 million pairs of rows."""
    works = spark.range(20_000).selectExpr("id", "array('brand', 'size', concat('x', id % 100), concat('y', id div 100)) AS words")
    asked = works.where("id % 10 = 0")
    assert M.nearest(asked, works.where("id % 10 <> 0")).count() == 2000

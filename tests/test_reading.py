"""Alignment, similar titles, the ledger's states, unique incoming records and lineage orders against plain computations."""

import random

import pytest

from quillgraph.functions import alignment as A
from quillgraph.operators import graph as G
from quillgraph.operators import reading as R


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_the_best_of_all_windows():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd ", k=rng.randint(1, 12))) for _ in range(2))
        if len(a) > len(b):
            a, b = b, a
        m, n = len(a), len(b)
        parts = [(i, i + m) for i in range(n - m + 1)] + [(0, k) for k in range(1, m)] + [(n - k, n) for k in range(1, m)]
        best = max(2 * common(a, b[s:e]) / (m + e - s) for s, e in parts)
        score, start, end = A.best_window(a, b)
        assert score == pytest.approx(best) and 2 * common(a, b[start:end]) / (m + end - start) == pytest.approx(best)


def test_align_odd_cases():
    assert A.align(None, "x") is None and A.align("  ", "x") is None and A.align("x", "") is None
    assert A.align(" The CAT ", "Lo, the cat sat") == ("the cat", 4, 11, 1.0)
    assert A.align("a long quote", "quote") == ("quote", 0, 5, 1.0)
    assert A.align("xyz", "İİ the xyz") == ("xyz", 7, 10, 1.0)
    assert A.align("the big cat sat", "so the cat sat there")[3] == pytest.approx(0.8, abs=0.07)


def test_quotes_of_a_table(spark):
    rows = spark.createDataFrame([(1, "Cat", "a cat"), (2, None, "a cat"), (3, "cat", None)], "id int, q string, s string")
    assert sorted(map(tuple, A.align_quotes(rows, "id", "q", "s").collect())) == [(1, "cat", 2, 5, 1.0), (2, None, None, None, None), (3, None, None, None, None)]


def test_similar_titles_against_all_pairs(spark):
    rng = random.Random(3)
    words = "graph neural network learning deep models language data".split()
    titles = [(i, " ".join(rng.choices(words, k=4))) for i in range(150)] + [(900, None), (901, "short")]
    asked = [(t.replace("e", "", 1).title(),) for _, t in titles[:40]] + [(None,), ("",)]
    got = {(r.raw, r.rank): (r.paper_id, round(r.score, 9)) for r in A.similar_titles(spark.createDataFrame(asked, "raw string"), spark.createDataFrame(titles, "paper_id int, title string"), block=7).collect()}
    want = {}
    for raw in {a for (a,) in asked if a}:
        scored = [(-round(2 * common(t, raw.lower()) / (len(t) + len(raw)), 9), i) for i, t in titles if t and len(t) >= 20]
        for rank, (s, i) in enumerate(sorted(x for x in scored if -x[0] >= 0.86)[:5], 1):
            want[raw, rank] = (i, -s)
    assert got == want and want


def test_ledger_states(spark):
    long = "A rather long title of one work"
    works = spark.createDataFrame([("w1",), ("w2",)], "citing string")
    raws = ["see arXiv:2401.00001", "doi:10.1000/none", f"B. Author. {long}. 1999", "In: Two works have this very title", "nothing known of this", "Purchase details here", "x" * 5001, "self arXiv:2401.00009", None]
    entries = spark.createDataFrame([("w1", i, r) for i, r in enumerate(raws, 1)], "citing string, pos int, raw string")
    titles = spark.createDataFrame([("p3", long), ("p4", "Two works have this very title"), ("p5", "Two works have this very title"), ("p6", None)], "paper_id string, title string")
    ids = spark.createDataFrame([("arxiv:2401.00001", "p1"), ("arxiv:2401.00009", "w1")], "alias string, paper_id string")
    first = R.ledger(works, entries, titles, ids)
    got = {r.reference_id: (r.state, r.target) for r in first.collect()}
    assert got == {
        "w1::ref0001": ("resolved_in_corpus", "p1"), "w1::ref0002": ("resolved_external", None), "w1::ref0003": ("resolved_in_corpus", "p3"), "w1::ref0004": ("ambiguous", None), "w1::ref0005": ("unresolved", None),
        "w1::ref0006": ("non_bibliographic", None), "w1::ref0007": ("malformed", None), "w1::ref0008": ("non_bibliographic", "w1"), "w1::ref0009": ("unresolved", None), "w2::retrieval": ("retrieval_unavailable", None),
    }
    done = first.where("reference_id LIKE '%1'").replace("resolved_in_corpus", "kept")
    again = {r.reference_id: r.state for r in R.ledger(works, entries, titles, ids, done).collect()}
    assert again == {k: v[0] for k, v in got.items()} | {"w1::ref0001": "kept"}


def test_lineage_order_is_a_depth_first_walk(spark):
    rng = random.Random(11)
    links = sorted({(a, b) for _ in range(90) for a, b in [sorted(rng.sample(range(60), 2))]} | {(70, 71)})
    children = {}
    for a, b in links:
        children.setdefault(a, []).append(b)
    nodes, heads = {x for e in links for x in e}, {b for _, b in links}
    seen = []

    def visit(u):
        if u not in seen:
            seen.append(u)
            for v in sorted(children.get(u, [])):
                visit(v)

    for root in sorted(nodes - heads):
        visit(root)
    got = G.lineage_order(spark.createDataFrame([*links, links[0], (5, 5)], "src int, dst int")).collect()
    for family in {r.family for r in got}:
        mine = [r.node for r in sorted((r for r in got if r.family == family), key=lambda r: r.place)]
        assert mine == [x for x in seen if x in mine] and family == min(mine)
    assert {r.node for r in got} == nodes


def test_similar_titles_of_lengths_too_far_apart(spark):
    long, short = [(f"{i:03} " + "many words about one thing " * 3,) for i in range(40)], [(i, f"{i:03} words about one thing") for i in range(40)]
    assert A.similar_titles(spark.createDataFrame(long, "raw string"), spark.createDataFrame(short, "paper_id int, title string"), block=1).count() == 0

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import op10_pitman_yor as op

TEXTS = [" ".join(f"w{(i * 7 + j * j) % 40}" for j in range(60)) for i in range(40)] + ["the end", "the the the", "", "w1 w2 only here"] * 3


def learned(spark, columns, texts=TEXTS):
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("held_out", F.lit(False))
    return op.learn(docs, columns)


def everything(model):
    """The model as dictionaries: parent's probability and count of each word; counts, tables and totals of each pair and context."""
    told, codes = model.told, model.codes
    parent, count = {}, {}
    for r in model.words.collect():
        word, n, customers, seats = (op.got(r[a], k) for a, k in zip("abcd", ("<u8", "<u8", "<u8", "<u4"), strict=True))
        parent |= dict(zip(word.tolist(), model.parent(customers, seats).tolist(), strict=True))
        count |= dict(zip(word.tolist(), n.tolist(), strict=True))
    here = told["hot_count"] > 0
    parent |= dict(zip(codes.hot[here].tolist(), model.parent(told["hot_customers"], told["hot_seats"])[here].tolist(), strict=True))
    count |= dict(zip(codes.hot[here].tolist(), told["hot_count"][here].tolist(), strict=True))
    totals = dict(zip(codes.names.tolist(), zip(told["customers"].tolist(), told["tables"].tolist(), strict=True), strict=True))
    for r in model.contexts.collect():
        totals |= {c: (n, t) for c, n, t in zip(*(op.got(r[a], k).tolist() for a, k in zip("abc", ("<u8", "<u4", "<u4"), strict=True)), strict=True)}
    pairs = {}
    for r in model.pairs.collect():
        word, context = codes.got_pairs(r.asDict())
        times = op.got(r.f, "<u4").astype(int)
        seats = np.full(len(times), op.SAMPLES)
        seats[times > 1] = op.got(r.g, "<u4")
        pairs |= {(w, c): (n, t) for w, c, n, t in zip(word.tolist(), context.tolist(), times.tolist(), seats.tolist(), strict=True)}
    return parent, count, totals, pairs


@pytest.mark.parametrize("columns", [1, 5])
def test_probabilities_sum_to_one(spark, columns):
    """Over the vocabulary and one unknown word, in the parent and in every context; counts are those of a plain count."""
    model = learned(spark, columns)
    parent, count, totals, pairs = everything(model)
    unknown = model.parent(np.zeros(1), np.zeros(1))[0]
    assert len(parent) == model.told["words"] and abs(sum(parent.values()) + unknown - 1) < 1e-9
    plain, words = Counter(), Counter()
    for t in TEXTS:
        tokens = [*t.split(), None]
        words.update(tokens)
        plain.update(zip([0, *t.split()], tokens, strict=True))
    assert sorted(count.values()) == sorted(words.values()) and sorted(n for n, _ in pairs.values()) == sorted(plain.values())
    for context in {c for _, c in pairs}:
        customers, tables = totals[context]
        rows = {w: x for (w, c), x in pairs.items() if c == context}
        assert customers == sum(n for n, _ in rows.values()) and tables == sum(t for _, t in rows.values())
        assert all(op.SAMPLES <= t <= op.SAMPLES * n for n, t in rows.values())
        share = op.context_weight(model.told, customers, tables)
        line = share * (sum(parent.values()) + unknown) + sum((n - model.told["discount"] * t / op.SAMPLES) / (op.STRENGTH + customers) for n, t in rows.values())
        assert abs(line - 1) < 1e-9


@pytest.mark.parametrize("columns", [1, 4])
def test_scores_are_the_models(spark, columns, monkeypatch):
    """Each text's score is the sum over its tokens of the log10 probability, computed one by one from the model; also for unseen words, contexts and pairs."""
    monkeypatch.setattr(op, "ROW_BLOCK", 500)
    model = learned(spark, columns)
    parent, _, totals, pairs = everything(model)
    unknown = float(model.parent(np.zeros(1), np.zeros(1))[0])
    texts = TEXTS[:5] + ["the w1 w39 w39", "never seen words", "w5", "", "w1 never w1 the end", None] * 7
    docs = spark.createDataFrame([(i, True, t) for i, t in enumerate(texts)], "id long, held_out boolean, text string").repartition(3)
    import pyarrow as pa

    for r in op.score_documents(docs, model).collect():
        want = 0.0
        for _, _, _, word, context in op.tokens(pa.array([texts[r.id]], pa.string())):
            for w, c in zip(word.tolist(), context.tolist(), strict=True):
                customers, tables = totals.get(c, (0, 0))
                n, t = pairs.get((w, c), (0, 0))
                want += math.log10((n - model.told["discount"] * t / op.SAMPLES) / (op.STRENGTH + customers) + op.context_weight(model.told, customers, tables) * parent.get(w, unknown))
        assert math.isclose(r.score, want, rel_tol=1e-5, abs_tol=1e-6)


def tables_exactly(customers, fresh, grows, d):
    """Distribution of tables of one dish, all seatings summed: weights of seatings one by one, without their normalisers."""
    ways = {1: 1.0}
    for n in range(1, customers):
        after = Counter()
        for t, w in ways.items():
            after[t] += w * (n - d * t)
            after[t + 1] += w * (fresh + grows * t)
        ways = after
    whole = sum(ways.values())
    return np.array([ways.get(t, 0) / whole for t in range(1, customers + 1)])


def test_seating_follows_the_exact_distribution():
    """The sampler's chain, many copies of one dish, against the sum over all seatings."""
    rng = np.random.default_rng(1)
    for customers, fresh, grows, d in ((5, 0.4, 0.1, 0.5), (9, 2.0, 0.3, 0.7), (3, 0.01, 0.005, 0.2)):
        k = 40_000
        seats, norm = np.ones(k, int), np.full(k, -np.inf)
        for _ in range(8):
            new, z = op.seat(np.full(k, customers), np.full(k, fresh), np.full(k, grows), d, rng)
            taken = np.log(rng.random(k)) < z - norm
            seats[taken], norm[taken] = new[taken], z[taken]
        got = np.bincount(seats, minlength=customers + 1)[1:] / k
        assert np.abs(got - tables_exactly(customers, fresh, grows, d)).max() < 0.015

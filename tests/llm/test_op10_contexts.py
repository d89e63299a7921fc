import math


def test_op10_contexts_grow_with_the_vocabulary(spark, monkeypatch):
    """Each word has one sure follower: far more words than a fixed number of restaurants could keep apart. Also with many blocks and hot words."""
    import numpy as np
    from pyspark.sql import functions as F

    from quillgraph.llm import op10_pitman_yor as op

    v, texts = 6000, 400
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"a{w} b{w} the" for w in rng.integers(0, v, 120))) for i in range(texts)]
    rows += [(1000 + i, " ".join(f"b{w} the" for w in rng.integers(0, v, 50)) + " new the unseen") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)

    def score():
        return {r.id: r for r in op.score_texts(df, "id", "text", F.col("id") >= 1000).collect()}

    one = score()
    sure = [r.score / r.n_tokens for r in one.values() if not r.held_out]
    # Of three tokens one is open, 1 of 6000; the others are known from the word before.
    assert np.mean(sure) > -math.log10(v) / 3 - 0.35
    monkeypatch.setattr(op, "COLUMN_BLOCK", 20_000)
    many = score()
    assert many.keys() == one.keys()
    assert all((a.n_tokens, a.n_known, a.train_tokens) == (b.n_tokens, b.n_known, b.train_tokens) and math.isclose(a.base_score, b.base_score, rel_tol=1e-9) for a, b in ((one[k], many[k]) for k in one))
    assert np.mean([abs(one[k].score - many[k].score) / one[k].n_tokens for k in one]) < 0.05
    assert score() == many

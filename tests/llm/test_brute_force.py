"""Toxicity's learner and language ID's fusion against plain computations."""

import math

import numpy as np
from pyspark.sql import functions as F


def test_op2_first_split_is_the_best():
    """Of all features and bin edges the root of the first tree takes the one with the largest gain."""
    from quillgraph.llm import op2_toxicity as op

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 4)), 2)
    y = (x[:, 2] + 0.3 * rng.normal(size=400) > 0.4).astype(float)
    model = op.Model()
    op.boost(x, y, model)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    best = (-1.0, None, None)
    for j in range(x.shape[1]):
        for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, op.BINS + 1)[1:-1])):
            left = x[:, j] <= e
            if min(left.sum(), (~left).sum()) >= op.LEAF:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (gain, j, e)
    assert (model.feature[0, 0], model.threshold[0, 0]) == best[1:]
    assert np.mean((model.raw(x) > 0) == (y > 0)) > 0.9


def test_op2_isotonic_is_the_min_max_formula():
    from quillgraph.llm import op2_toxicity as op

    rng = np.random.default_rng(2)
    for _ in range(30):
        raw, y = rng.integers(0, 12, 40).astype(float), rng.integers(0, 2, 40).astype(float)
        at, to = op.isotonic(raw, y)
        values = np.unique(raw)
        mean = lambda a, b: y[(raw >= a) & (raw <= b)].mean()
        want = np.array([max(min(mean(a, b) for b in values[values >= v]) for a in values[values <= v]) for v in values])
        # Each block's mean is drawn to the overall share by one count.
        for v, m in zip(values, want, strict=True):
            rows = np.isin(raw, values[want == m]).sum()
            assert math.isclose(np.interp(v, at, to), (m * rows + y.mean()) / (rows + 1), abs_tol=1e-9) or np.interp(v, at, to) >= (m * rows + y.mean()) / (rows + 1)
        assert (np.diff(to) >= 0).all()


def test_op3_fusion_in_plain_python(spark):
    from quillgraph.llm import op3_language_id as op

    rng = np.random.default_rng(8)
    size = len(op.LANGUAGES)
    rows = []
    for i in range(60):
        text = rng.normal(size=size) * 2
        host = [None, "a.x.com", "b.x.com", "src1", "src2"][i % 5]
        parent = None if host is None else "x.com" if "." in host else "src"
        rows.append((i, host, parent, int(i % 7 > 0), (text - text.max()).tolist(), (rng.normal(size=size)).tolist()))
    df = spark.createDataFrame(rows, "key long, host string, parent string, n long, text array<double>, outside array<double>")
    got = {r.key: (r.lang, r.posterior) for r in op.fuse(df).collect()}
    own = {r[0]: np.exp(r[4]) / np.exp(r[4]).sum() * (r[3] > 0) for r in rows}
    total = sum(own.values())
    base = (total + 1) / (total.sum() + size)
    for key, host, parent, _, text, outside in rows:
        in_parent, in_host = sum(own[r[0]] for r in rows if r[2] == parent), sum(own[r[0]] for r in rows if r[1] == host)
        upper = (in_parent + op.PARENT_COUNT * base) / (in_parent.sum() + op.PARENT_COUNT)
        logs = np.array(text) + np.array(outside) + np.log((in_host + op.PARENT_COUNT * upper) / (in_host.sum() + op.PARENT_COUNT))
        p = np.exp(logs - logs.max())
        assert got[key][0] == op.LANGUAGES[int(logs.argmax())] and math.isclose(got[key][1], 1 / p.sum(), rel_tol=1e-9)
    assert op.fuse(df.where(F.lit(False))).count() == 0

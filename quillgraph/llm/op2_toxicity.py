"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (words, and beginnings of words, whose share among toxic texts is
far above that among others), how near lexicon words stand to the second person, and rates of capitals,
punctuation and obfuscation. The lexicon, the trees and the calibration are learned from labelled rows only:
the lexicon and the trees from three quarters of them, the isotonic map of tree scores to probabilities from the
rest, so that it is fitted on scores of unseen texts; both parts are chosen by hash of the id.

The classifier is fitted on a bounded sample of labelled rows, MAX_TRAINING, taken by hash of the id (all of them
where there are no more). Counting the lexicon's terms and computing features are distributed; what reaches the
driver are at most LEXICON terms and MAX_TRAINING rows of some twenty numbers. Scoring is one pass
over the texts with the model in the tasks' closure (some ten kB of trees and the lexicon).

Nulls and odd rows: a null or empty text gets the score of its (zero) features. Labels that are null are
not learned from, those that contradict each other for an id count by their mean, at least one half is toxic;
a label whose id repeats in the table is counted for each row. Without any usable labels, or with labels of one kind
only, every score is the share of toxic labels (0 without labels). An empty table gives an empty
result; other columns are not read: source, lang and id are no features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import table, tidy

#: Labelled rows that are learned from, and terms of the lexicon, at most.
MAX_TRAINING, LEXICON = 16_000, 4096
#: A term joins the lexicon by so many toxic texts and this log odds ratio, at least.
MIN_TOXIC, MIN_LOG_ODDS = 3, 2.5
#: Lengths of the beginnings of words that count as terms beside whole words.
STEMS = (4, 5, 6)
REJECT_AT = 0.7
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.2, 32, 8

#: Second-person words of the supported languages (fixed list).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os su".split())
#: Words within which a second-person word counts as near.
NEAR = 6

WORD = re.compile(r"[^\W\d_]+")
ALL_CAPITALS = re.compile(r"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
#: Term weights from which a lexicon word counts as strong, and words whose weight a worker remembers.
STRONG, REMEMBERED = 4.0, 200_000

#: Kinds of ASCII bytes: capitals, small letters (and all bytes of other letters), digits, punctuation, the rest.
CAPITAL, SMALL, DIGIT, MARK, REST = range(5)
KIND = np.full(256, REST, dtype=np.uint8)
KIND[33:127] = MARK
KIND[48:58] = DIGIT
KIND[65:91] = CAPITAL
KIND[97:123] = SMALL
KIND[128:] = SMALL
#: Signs that stand for letters inside words.
DISGUISE = np.zeros(256, dtype=bool)
DISGUISE[list(b"@$*#!0134578|")] = True

NAMES = (
    "words", "mean_word", "lexicon", "lexicon_rate", "strong", "strong_rate", "strongest", "distinct", "near_you", "near_you_rate",
    "second_person_rate", "capitals_rate", "all_capitals_rate", "punctuation_rate", "exclamation_rate", "obfuscated_rate", "digits_rate",
)


def terms_of(word: str) -> Iterator[str]:
    """The word, and its beginnings marked with a star."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


class Weights(dict):
    """Weight of a word: its heaviest term's; -1 for the second person. Remembers up to REMEMBERED words."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        get = self.lexicon.get
        weight = self[word] = -1.0 if word in SECOND_PERSON else max(get(t, 0.0) for t in terms_of(word))
        return weight


def features(text: str | None, weights: Weights) -> list[float]:
    """The numbers that NAMES names."""
    text = text or ""
    found = WORD.findall(text.lower())
    n, total = max(len(found), 1), max(len(text), 1)
    weight = np.fromiter(map(weights.__getitem__, found), np.float64, len(found))
    places, second = np.flatnonzero(weight > 0), np.flatnonzero(weight < 0)
    near = 0
    if len(second) and len(places):
        k = np.searchsorted(second, places)
        gap = np.minimum(np.abs(second[np.minimum(k, len(second) - 1)] - places), np.abs(second[np.maximum(k - 1, 0)] - places))
        near = int((gap <= NEAR).sum())
    hits = weight[places]
    strong = int((hits >= STRONG).sum())
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    kind = KIND[raw]
    counts = np.bincount(kind, minlength=5)
    letter = kind <= SMALL
    disguised = int((letter[:-2] & DISGUISE[raw[1:-1]] & letter[2:]).sum()) if len(raw) > 2 else 0
    if len(raw) > 3:
        same = raw[1:] == raw[:-1]
        disguised += int((same[2:] & same[1:-1] & same[:-2] & (kind[3:] <= SMALL) & (raw[3:] < 128)).sum())
    return [
        float(np.log1p(len(found))), sum(map(len, found)) / n, float(np.log1p(len(places))), 100 * len(places) / n, float(np.log1p(strong)), 100 * strong / n,
        float(hits.max(initial=0)), float(len({found[i] for i in places})), float(np.log1p(near)), 100 * near / n, 100 * len(second) / n,
        100 * counts[CAPITAL] / total, 100 * len(ALL_CAPITALS.findall(text)) / n, 100 * counts[MARK] / total,
        100 * text.count("!") / total, 100 * disguised / n, 100 * counts[DIGIT] / total,
    ]


@dataclass
class Model:
    """Boosted trees of fixed depth as arrays, and the steps of the isotonic map."""

    lexicon: dict[str, float] = field(default_factory=dict)
    start: float = 0.0
    feature: np.ndarray | None = None  # (trees, 2**DEPTH - 1)
    threshold: np.ndarray | None = None
    leaf: np.ndarray | None = None  # (trees, 2**DEPTH)
    steps: tuple[np.ndarray, np.ndarray] | None = None
    constant: float = 0.0
    weights: Weights | None = None  # of one worker

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, f[node]] > t[node])
            total += v[node - (2**DEPTH - 1)]
        return total

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.feature is None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        if self.weights is None:
            self.weights = Weights(self.lexicon)
        raw = self.raw(np.array([features(t, self.weights) for t in texts]))
        return np.interp(raw, *self.steps)


def boost(x: np.ndarray, y: np.ndarray, model: Model) -> None:
    """Newton boosting of the logistic loss; splits lie at quantiles of each feature."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], axis=1)
    model.start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), model.start)
    inner = 2**DEPTH - 1
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for k in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        for at in range(inner):
            here = np.flatnonzero(node == at)
            best = (1e-6, 0, np.inf)
            if len(here) >= 2 * LEAF:
                gs, hs = g[here], h[here]
                whole = gs.sum() ** 2 / (hs.sum() + 1)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    bins = binned[here, j]
                    left_g, left_h = np.cumsum(np.bincount(bins, gs, len(e) + 1))[:-1], np.cumsum(np.bincount(bins, hs, len(e) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(bins, minlength=len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (gs.sum() - left_g) ** 2 / (hs.sum() - left_h + 1) - whole
                    gain[(left_n < LEAF) | (len(here) - left_n < LEAF)] = -1
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, float(e[b]))
            feature[k, at], threshold[k, at] = best[1:]
            node[here] = 2 * at + 1 + (x[here, best[1]] > best[2])
        node -= inner
        leaf[k] = RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + 1)
        margin += leaf[k][node]
    model.feature, model.threshold, model.leaf = feature, threshold, leaf


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the blocks' means, each smoothed by one pseudo-count of the overall share, at the blocks' ends."""
    order = np.argsort(raw, kind="stable")
    values, first = np.unique(raw[order], return_index=True)
    sums, counts = np.add.reduceat(y[order], first), np.diff(np.append(first, len(y)))
    blocks: list[list[float]] = []  # sum, count, first value, last value
    for v, s, c in zip(values, sums, counts, strict=True):
        blocks.append([float(s), float(c), float(v), float(v)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s2, c2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2], last]
    share = y.mean()
    at = np.array([b for block in blocks for b in block[2:]])
    to = np.maximum.accumulate(np.repeat([(b[0] + share) / (b[1] + 1) for b in blocks], 2))
    return at, np.clip(to, 0, 1)


def learn(texts: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, usable: Column | None = None, max_rows: int = MAX_TRAINING) -> Model:
    """A model from the labels (of id_col, label_col) that `usable`, an expression over their id_col, allows."""
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    if usable is not None:
        labels = labels.withColumnRenamed("id", id_col).where(usable).withColumnRenamed(id_col, "id")
    labels = labels.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("toxic")).withColumn("turn", F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1_000_000)))
    total = labels.count()
    share = min(1.0, max_rows / max(total, 1))
    # At most about max_rows rows of 16 bytes: a bound that allows to send them to every task.
    chosen = labels.where(F.col("turn") < int(share * 1_000_000))
    known = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").withColumn("calibrates", F.col("turn") % 4 == 3)

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts by term and label, over this partition. The row of the empty term counts texts."""
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for rows in batches:
            for text, toxic in zip(rows.column(0), rows.column(1).to_pylist(), strict=True):
                counts[toxic].update({t for w in set(WORD.findall((text.as_py() or "").lower())) for t in terms_of(w)})
                counts[toxic][""] += 1
        # A term that no toxic text of the partition has can only lower others' odds: it is sent like the rest.
        names = sorted({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][t] for t in names], pa.int64()), pa.array([counts[0][t] for t in names], pa.int64())], names=["term", "toxic", "other"])

    terms = known.where("NOT calibrates").select("text", "toxic").mapInArrow(tidy(count_terms), "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    strong = terms.where((F.col("toxic") >= MIN_TOXIC) | (F.col("term") == "")).orderBy(F.col("term") != "", F.desc((F.col("toxic") + 0.5) / (F.col("other") + 0.5)), F.desc("toxic"), "term").limit(2 * LEXICON).collect()
    n_toxic, n_other = next(((r.toxic, r.other) for r in strong if r.term == ""), (0, 0))
    model = Model()
    if not n_toxic or not n_other:
        rate = known.agg(F.avg("toxic")).first()[0]
        model.constant = float(rate or 0.0)
        return model
    odds = ((r.term, float(np.log((r.toxic + 0.5) / (n_toxic + 1)) - np.log((r.other + 0.5) / (n_other + 1)))) for r in strong if r.term)
    model.lexicon = dict(sorted(((t, o) for t, o in odds if o >= MIN_LOG_ODDS), key=lambda x: (-x[1], x[0]))[:LEXICON])
    lexicon = model.lexicon

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(lexicon)
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([features(t.as_py(), weights) for t in part.column(1)], pa.list_(pa.float64()))], names=["id", "toxic", "calibrates", "x"])

    rows = known.select(F.col("id").cast("string").alias("id"), "text", "toxic", "calibrates").mapInArrow(tidy(describe), "id string, toxic int, calibrates boolean, x array<double>")
    got = sorted(rows.collect(), key=lambda r: (r.id, r.x))
    x, y, held = np.array([r.x for r in got]), np.array([r.toxic for r in got], dtype=np.float64), np.array([r.calibrates for r in got])
    boost(x[~held], y[~held], model)
    use = held if held.any() and 0 < y[held].mean() < 1 else np.ones(len(y), bool)
    model.steps = isotonic(model.raw(x[use]), y[use])
    return model


def score(df: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """id_col and score (0 to 1) of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score([t.as_py() for t in part.column(1)]))], names=["id", "score"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(tidy(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def remainder(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % n


def fitted(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> Model:
    """From the labels of doc_id whose crc32 modulo 3 is not 1."""
    documents = table(spark, sf_dir, "documents") if documents is None else documents
    return learn(documents, "doc_id", "text", table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 3) != 1)


def keep_clean(docs: DataFrame, model: Model, reject_at: float = REJECT_AT) -> DataFrame:
    """The rows of docs whose score is below reject_at, with all their columns."""
    columns = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_text = columns.index("text")
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                yield part.filter(pa.array(model.score([t.as_py() for t in part.column(at_text)]) < reject_at))

    return docs.mapInArrow(tidy(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, "doc_id", "text", fitted(spark, sf_dir, documents))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}

"""Alignment of quotes with the texts they come from, and similarity of titles, both by insertions and deletions only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import identity as I

#: The least similarity of a diagnosed title, its least length, and how many are shown.
LEAST_RATIO, LEAST_TITLE, MOST_SHOWN = 0.86, 20, 5
ALPHABET = " 0123456789abcdefghijklmnopqrstuvwxyz"


class Pattern:
    """A string made ready for its longest common subsequence with many others: a bit for each place, by character."""

    def __init__(self, text: str):
        self.size, self.full, self.places = len(text), (1 << len(text)) - 1, {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def common(self, other: str) -> int:
        """Length of the longest common subsequence."""
        row = self.full
        for c in other:
            hit = row & self.places.get(c, 0)
            row = ((row + hit) | (row - hit)) & self.full
        return self.size - row.bit_count()

    def ratio(self, other: str) -> float:
        total = self.size + len(other)
        return 2 * self.common(other) / total if total else 1.0


def lowered(text: str) -> str:
    """Lower case at the same length, so that places stay valid."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def best_window(a: str, b: str) -> tuple[float, int, int]:
    """Ratio and bounds of the part of b, of a's length or cut off by b's ends, most like a, which is no longer than b.

    Windows of full length come first, the earliest best one; parts at the ends must be strictly better. From one window to the next the
    common length changes by one at most, so windows that can't beat the best are stepped over.
    """
    p, m, n = Pattern(a), len(a), len(b)
    best, at, i = -1, 0, 0
    while i <= n - m:
        common = p.common(b[i : i + m])
        if common > best:
            best, at = common, i
        i += max(1, best + 1 - common)
    score, bounds = best / m, (at, at + m)
    for k in range(m - 1, 0, -1):
        if 2 * k / (m + k) <= score:
            break
        for start in (0, n - k):
            if (s := p.ratio(b[start : start + k])) > score:
                score, bounds = s, (start, start + k)
    return score, *bounds


def align(quote: str | None, source: str | None) -> tuple[str, int, int, float] | None:
    """The source's own words for a quote, where they begin and end, and how well they agree (0 to 1); None without quote or source."""
    q = (quote or "").strip()
    if not q or not source:
        return None
    a, b = lowered(q), lowered(source)
    whole = (0, len(b))
    if len(a) > len(b):
        score, start, end = best_window(b, a)[0], *whole
    elif (found := b.find(a)) >= 0:
        score, start, end = 1.0, found, found + len(a)
    else:
        score, start, end = best_window(a, b)
        if len(a) == len(b) and (other := best_window(b, a)[0]) > score:
            score, start, end = other, *whole
    return source[start:end].strip(), start, end, round(score, 3)


def align_quotes(rows: DataFrame, ident: str, quote: str, source: str) -> DataFrame:
    """ident, quote_verbatim, quote_start, quote_end, grounding of each row; the last four are null without quote or source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [align(q, s) or (None,) * 4 for q, s in zip(part[quote], part[source], strict=True)]
            out = pd.DataFrame(found, columns=["quote_verbatim", "quote_start", "quote_end", "grounding"], dtype=object)
            out.insert(0, ident, part[ident].to_numpy())
            yield out.astype({"quote_start": "Int64", "quote_end": "Int64", "grounding": "Float64"})

    return rows.select(ident, quote, source).mapInPandas(run, f"{ident} {rows.schema[ident].dataType.simpleString()}, quote_verbatim string, quote_start long, quote_end long, grounding double")


def bags(texts: list[str]) -> np.ndarray:
    """How often each letter of the alphabet comes in each text."""
    counts = [Counter(t) for t in texts]
    return np.array([[c[x] for x in ALPHABET] for c in counts], dtype=np.int32).reshape(len(texts), len(ALPHABET))


def similar_titles(asked: DataFrame, titles: DataFrame, least: float = LEAST_RATIO, most: int = MOST_SHOWN, block: int = 2000) -> DataFrame:
    """raw, paper_id, score, rank: for each distinct text of `asked` (raw) the papers of `titles` (paper_id, title) with the most similar titles.

    For people to look at, never to link by. Texts are asked in blocks, each of which reads the titles once, of those whose length allows the ratio
    with some title; lengths and letters common to both bound it before it is computed. Equal scores go by paper_id; null texts and short titles take no part.
    """
    held = titles.select("paper_id", I.title_key(F.col("title")).alias("key")).where(F.length("key") >= LEAST_TITLE).distinct()
    wanted = asked.select("raw", I.title_key(F.col("raw")).alias("key")).where("key <> ''").distinct()
    sizes = [[r[0] for r in x.select(F.length("key")).distinct().collect()] for x in (wanted, held)]
    near = lambda n, others: any(2 * min(n, o) >= least * (n + o) for o in others)
    wanted, held = (x.where(F.length("key").isin([n for n in mine if near(n, others)])) for x, mine, others in ((wanted, *sizes), (held, *sizes[::-1])))
    blocks = max(1, -(-wanted.count() // block))
    schema = f"raw string, paper_id {titles.schema['paper_id'].dataType.simpleString()}, score double"
    found = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("raw"), F.lit(blocks)) == b).collect()
        part = held.mapInPandas(_comparer([(r["raw"], r["key"]) for r in rows], least), schema)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("raw", "paper_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("raw").orderBy(F.desc("score"), "paper_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= most)


def _comparer(asked: list[tuple[str, str]], least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(raw, Pattern(key)) for raw, key in asked]
        letters = bags([key for _, key in asked])
        for part in batches:
            keys, ids = part["key"].tolist(), part["paper_id"].tolist()
            have, sizes, out = bags(keys), np.array([len(k) for k in keys], dtype=np.int32), []
            for (raw, p), mine in zip(patterns, letters, strict=True):
                need = least * (sizes + p.size)
                near = np.flatnonzero(2 * np.minimum(sizes, p.size) >= need)
                near = near[2 * np.minimum(have[near], mine).sum(axis=1) >= need[near]]
                out += [(raw, ids[i], s) for i in near if (s := p.ratio(keys[i])) >= least]
            yield pd.DataFrame(out, columns=["raw", "paper_id", "score"])

    return run

"""The boundary to model labelling: a batch function from rows to rows, with a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gets a batch of rows and returns rows of the declared schema; it may leave rows out.
Labeller = Callable[[pd.DataFrame], pd.DataFrame]


def label(rows: DataFrame, labeller: Labeller, schema: str, batch: int = 12) -> DataFrame:
    """Applies a labeller batch by batch within each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for at in range(0, len(part), batch):
                yield labeller(part.iloc[at : at + batch])

    return rows.mapInPandas(run, schema)


def scope(rows: DataFrame, ident: str, labeller: Labeller) -> DataFrame:
    """rows with in_scope: those left out are asked once more; what stays undecided is kept."""
    schema = f"{ident} {rows.schema[ident].dataType.simpleString()}, in_scope boolean"
    first = label(rows, labeller, schema).groupBy(ident).agg(F.max("in_scope").alias("first"))
    left = rows.join(first, ident, "left_anti")
    second = label(left, labeller, schema).groupBy(ident).agg(F.max("in_scope").alias("second"))
    return rows.join(first, ident, "left").join(second, ident, "left").withColumn("in_scope", F.coalesce("first", "second", F.lit(True))).drop("first", "second")


def clamp_verdict(rows: DataFrame, verdicts: tuple[str, ...] = ("correct", "incorrect", "unsure")) -> DataFrame:
    """Confidence within 0 and 1, unknown verdicts unsure."""
    return rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))).withColumn("verdict", F.when(F.col("verdict").isin(*verdicts), F.col("verdict")).otherwise("unsure"))


def keyword_labeller(ident: str, text: str, words: tuple[str, ...]) -> Labeller:
    """The stand-in: in scope if the text holds one of the words."""
    return lambda rows: pd.DataFrame({ident: rows[ident], "in_scope": [any(w in str(t).lower() for w in words) for t in rows[text]]})


def restating(rows: pd.DataFrame) -> pd.DataFrame:
    """A reader's stand-in: each contribution is claimed once, each claim supports the next."""
    claims = [[{"text": f"On {c['statement']}", "claim_type": "empirical", "evidence": "", "confidence": 0.75, "contribution": i} for i, c in enumerate(cs)] for cs in rows["contributions"]]
    links = [[{"src": i, "dst": i + 1, "relation": "supports", "evidence": ""} for i in range(len(cs))] for cs in rows["contributions"]]
    return pd.DataFrame({"paper_id": rows["paper_id"], "claims": claims, "local_edges": links})

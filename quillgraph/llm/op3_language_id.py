"""Language ID by Bayesian evidence fusion.

Four kinds of evidence about a row's language are multiplied and normalised:

- the text: likelihood under a byte-trigram model of each language (hashed, add-one smoothed);
- the declared language: a column, or the `lang` attribute of the markup's html element where the text is markup;
- the address suffix: the country or path label of the row's address, or of the first web or mail address in the text;
- the host: a distribution that is smoothed hierarchically, host towards parent domain towards all rows, from
  counts that grouped aggregations make over all rows' texts.

The trigram models are fitted on a bounded sample, MAX_TRAINING rows, of rows whose declared language is one of LANGUAGES;
These distributions are counted over all rows, each by its text's own posterior. The text is read once for learning and
once for scoring; what lies between is a table of a few numbers a row. The joins with them are on host and
parent, one row each, so a host with a third of all rows is a skewed side that Spark splits.

A row is rejected if it has no evidence from its text (no letters), or if the best language's posterior is
below MIN_POSTERIOR.

Nulls and odd rows: a null or empty text gives even likelihoods, and is rejected; null or unknown declarations, suffixes and hosts say
nothing (null hosts share one group). Repeated rows are judged alike. An empty table gives an empty result. Ties go to
the language first in LANGUAGES. Extra columns are ignored by identify() and kept by keep_known().
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import checkpointed, mix, table, text_chunks, tidy

LANGUAGES = ("en", "de", "fr", "es")
MAX_TRAINING, BUCKETS = 8_000, 1 << 15
#: Chance that a declaration, and that an address suffix, names the right language.
DECLARED_RIGHT, SUFFIX_RIGHT = 0.9, 0.8
#: Pseudo-counts by which a parent's distribution smooths its child's.
PARENT_COUNT = 20.0
#: The text's log likelihood counts as that of so many independent trigrams at most: neighbours are not independent.
MOST_TRIGRAMS = 400
MIN_POSTERIOR = 0.5
#: Rejected keys that are sent to every task, at most.
BROADCAST_ROWS = 200_000
#: Languages of address labels (fixed list).
SUFFIXES = {"en": "en", "uk": "en", "us": "en", "au": "en", "ie": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es"}

HTML_TAG = re.compile(r"<html\b[^>]*", re.IGNORECASE)
MARKUP_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2})", re.IGNORECASE)
ADDRESS = re.compile(r"(?:https?://|www\.|@)([A-Za-z0-9.-]+)(?:/([a-z]{2})(?=[/?#\s]|$))?")
FOLD = np.arange(256, dtype=np.uint64)
FOLD[65:91] += 32
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram that holds a letter, and its text's position. Bytes other than letters count as one."""
    code = np.where(LETTER[data], FOLD[data], np.uint64(32))
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = code[:-2] << np.uint64(16) | code[1:-1] << np.uint64(8) | code[2:]
    at = np.flatnonzero(LETTER[data[1:-1]])
    return (mix(joined[at]) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(offsets, at + 1, side="right") - 1


def learn(df: DataFrame, text_col: str, declared: Column, languages: Sequence[str] = LANGUAGES, max_rows: int = MAX_TRAINING) -> np.ndarray:
    """Log probability of each bucket by language: (languages, BUCKETS)."""
    rows = df.select(F.col(text_col).alias("text"), declared.alias("lang")).where(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    share = min(1.0, max_rows / max(rows.select("lang").count(), 1))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        place = {l: i for i, l in enumerate(languages)}
        for batch in batches:
            lang = np.array([place[l] for l in batch.column(1).to_pylist()], dtype=np.int64)
            for first, data, offsets in text_chunks(batch.column(0)):
                bucket, row = trigrams(data, offsets)
                np.add.at(counts, (lang[first + row], bucket), 1)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[lang, bucket])], names=["lang", "bucket", "n"])

    # At most languages x BUCKETS rows reach the driver.
    totals = np.ones((len(languages), BUCKETS))
    for r in sample.mapInArrow(tidy(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        totals[r.lang, r.bucket] += r.n
    return (np.log(totals) - np.log(totals.sum(axis=1, keepdims=True))).astype(np.float32)


def likelihoods(batch_texts, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text by language, tempered, and the count of its trigrams."""
    n = len(batch_texts)
    total, count = np.zeros((n, len(model))), np.zeros(n, dtype=np.int64)
    for first, data, offsets in text_chunks(batch_texts):
        bucket, row = trigrams(data, offsets)
        k = len(offsets) - 1
        count[first : first + k] = np.bincount(row, minlength=k)
        for j, logs in enumerate(model):
            total[first : first + k, j] = np.bincount(row, logs[bucket], k)
    scale = np.minimum(1.0, MOST_TRIGRAMS / np.maximum(count, 1))
    total *= scale[:, None]
    return total - total.max(axis=1, keepdims=True, initial=-np.inf) if len(model) else total, count


def markup_lang(text: str) -> str | None:
    """The first declaration by an html element, wherever it stands."""
    return next((m[1] for tag in HTML_TAG.finditer(text) if (m := MARKUP_LANG.search(tag[0]))), None)


def evidence(df: DataFrame, key: str, text_col: str, model: np.ndarray, declared: Column, url: Column, host: Column, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """key, host, parent, n (trigrams), text (log likelihoods), outside (log likelihoods of declaration and suffix)."""
    kind = df.schema[key].dataType.simpleString()
    place = {l: i for i, l in enumerate(languages)}
    others = max(len(languages) - 1, 1)

    def told(lang: str | None, right: float) -> np.ndarray:
        logs = np.zeros(len(languages))
        if lang in place:
            logs[:] = np.log((1 - right) / others)
            logs[place[lang]] = np.log(right)
        return logs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs, count = likelihoods(batch.column(1), model)
            outside = []
            for text, lang, address in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text.as_py() or ""
                if lang is None:
                    lang = markup_lang(text)
                m = ADDRESS.search(address if address is not None else text)
                suffix = (m[2] if m and m[2] in SUFFIXES else m[1].rstrip(".").rpartition(".")[2].lower()) if m else ""
                outside.append(told(lang[:2].lower() if lang else None, DECLARED_RIGHT) + told(SUFFIXES.get(suffix), SUFFIX_RIGHT))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(4), pa.array(count), pa.array(logs.tolist(), pa.list_(pa.float64())), pa.array([o.tolist() for o in outside], pa.list_(pa.float64()))],
                names=["key", "host", "n", "text", "outside"],
            )

    found = df.select(F.col(key).alias("key"), F.col(text_col).alias("body"), declared.cast("string").alias("lang"), url.cast("string").alias("url"), host.cast("string").alias("host")).mapInArrow(
        tidy(run), f"key {kind}, host string, n long, text array<double>, outside array<double>"
    )
    # The parent of a host is what follows its first dot; a name without a dot loses its digits (src12 -> src).
    dotted = F.regexp_replace("host", r"^[^.]*\.", "")
    return found.withColumn("parent", F.when(F.col("host").contains("."), dotted).otherwise(F.regexp_replace("host", r"\d+$", "")))


def fuse(rows: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """rows of evidence() -> key, lang, posterior, n: with distributions by host, counted over these rows."""
    size = len(languages)
    own = F.expr("transform(text, x -> exp(x) / aggregate(text, cast(0 as double), (a, y) -> a + exp(y)))")
    soft = rows.withColumn("own", own)
    sums = [F.sum(F.when(F.col("n") > 0, F.col("own")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(size)]
    by_host = checkpointed(soft.groupBy("host", "parent").agg(*sums))
    by_parent = by_host.groupBy("parent").agg(*[F.sum(f"s{i}").alias(f"p{i}") for i in range(size)])
    whole = by_host.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"w{i}") for i in range(size)]).first()
    total = sum(whole)
    base = [(w + 1) / (total + size) for w in whole]
    add = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    in_parent, in_host = add([f"p{i}" for i in range(size)]), add([f"s{i}" for i in range(size)])
    h, p = by_host.alias("h"), by_parent.alias("p")
    host_odds = h.join(p, F.col("h.parent").eqNullSafe(F.col("p.parent"))).select("h.*", *[((F.col(f"p{i}") + PARENT_COUNT * base[i]) / (in_parent + PARENT_COUNT)).alias(f"q{i}") for i in range(size)])
    host_odds = host_odds.select("host", F.array(*[F.log((F.col(f"s{i}") + PARENT_COUNT * F.col(f"q{i}")) / (in_host + PARENT_COUNT)) for i in range(size)]).alias("host_odds"))
    r, q = rows.alias("r"), host_odds.alias("q")
    joined = r.join(q, F.col("r.host").eqNullSafe(F.col("q.host")), "left").select("r.key", "r.n", "r.text", "r.outside", "q.host_odds")
    logs = F.array(*[F.col("text")[i] + F.col("outside")[i] + F.coalesce(F.col("host_odds")[i], F.lit(float(np.log(base[i])))) for i in range(size)])
    joined = joined.withColumn("logs", logs).withColumn("most", F.array_max("logs"))
    names = F.array(*map(F.lit, languages))
    return joined.select("key", "n", F.element_at(names, F.array_position("logs", F.col("most")).cast("int")).alias("lang"), F.expr("1 / aggregate(logs, cast(0 as double), (a, y) -> a + exp(y - most))").alias("posterior"))


def identify(df: DataFrame, key: str, text_col: str, declared: Column | None = None, url: Column | None = None, host: Column | None = None) -> DataFrame:
    """key, lang, posterior, keep of each row. Without a host column rows share one distribution; without a url the text's first address counts."""
    nothing = F.lit(None).cast("string")
    declared, url, host = (nothing if c is None else c for c in (declared, url, host))
    model = learn(df, text_col, declared)
    rows = checkpointed(evidence(df, key, text_col, model, declared, url, host))
    keep = (F.col("n") > 0) & (F.col("posterior") >= MIN_POSTERIOR)
    return fuse(rows).select(F.col("key").alias(key), "lang", "posterior", keep.alias("keep"))


def keep_known(docs: DataFrame, key: str, text_col: str, declared: Column, host: Column) -> DataFrame:
    """The rows of docs that are not rejected, with their columns as they are. Rows of one key go together: one is kept if any row of its key is."""
    judged = identify(docs, key, text_col, declared=declared, host=host)
    # Rejections are few as a rule: then the documents need no shuffle. Beyond the bound they are joined by one.
    rejected = judged.groupBy(F.col(key).alias("rejected_key")).agg(F.max("keep").alias("any")).where(~F.col("any")).select("rejected_key")
    rejected = checkpointed(rejected)
    if rejected.count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    return docs.join(rejected, docs[key].eqNullSafe(rejected["rejected_key"]), "left_anti")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, "doc_id", "text", declared=F.col("lang"), host=F.col("source"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}

"""A training-corpus pipeline of five stages, each one of the operators of quillgraph.llm.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

In all stages a null text is an empty one, rows that repeat an id are rows of their own, columns other than those of
documents are dropped, and an empty table gives an empty result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import op2_toxicity, op3_language_id, op4_ngram_jaccard, op7_mixing, op9_bpe
from quillgraph.llm.common import small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated toxicity is 0.7 or more, each row by its own text; the model learns from the labelled ones among docs. Empty texts stay unless most labelled ones are toxic."""
    small_batches(spark)
    model = op2_toxicity.fitted(spark, sf_dir, docs)
    return op2_toxicity.keep_clean(docs.select(*COLUMNS), model)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which no language is probable, or that hold no letters (so empty texts go). Rows of one id, or all without one, go only together: they stay if any of them does. A null source is a host of its own."""
    small_batches(spark)
    return op3_language_id.keep_known(docs.select(*COLUMNS), "doc_id", "text", F.col("lang"), F.col("source"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near duplicates the document with the smallest id (without an id only if none has one). Different texts under one id are told apart; texts without words all stay."""
    small_batches(spark)
    return op4_ngram_jaccard.keep_one(docs.select(*COLUMNS), "doc_id", "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: a document comes as often as the mix takes it, up to twice or not at all. Null is a source; rows of one id and source are taken alike; texts without words count nothing and come with their hash."""
    return op7_mixing.take(docs.select(*COLUMNS), "doc_id", "source", op7_mixing.words_in("text"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document in byte-level BPE, its digests, and the round trip's."""
    small_batches(spark)
    return op9_bpe.digests(docs, "doc_id", "text", *op9_bpe.vocabulary())


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: The first two stages rest on models that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What each keeps is a table in the cluster's checkpoint folder (one of this machine's only where none is named)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs

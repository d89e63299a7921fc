from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quillgraph.llm import op4_ngram_jaccard, op7_mixing, op9_bpe


def test_stages_agree_with_their_operators(spark, odd):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], odd)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1])
    # Texts without letters are rejected by language; the rest stays.
    assert not {0, 1, 2} & set(ids[2])
    judged = op4_ngram_jaccard.near_duplicates(kept[2], "doc_id", "text").collect()
    assert set(ids[3]) == {r.component_id for r in judged} and max(ids[3].values()) == 1
    copies = {r.doc_id: r.copies for r in op7_mixing.mix(kept[3], "doc_id", "source", op7_mixing.words_in("text")).collect()}
    assert ids[4] == Counter({i: c for i, c in copies.items() if c})
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], odd)
    assert Counter(r.doc_id for r in last.collect()) == ids[4]
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run(spark, odd):
    assert corpus_pipeline.run(spark, odd).where(F.col("n_tokens") < 0).count() == 0


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_digest_columns(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert op9_bpe.digests(df, "doc_id", "text", *op9_bpe.vocabulary()).count() == 1

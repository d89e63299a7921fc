def test_op3_late_markup_language(spark):
    from pyspark.sql import functions as F

    from quillgraph.llm import op3_language_id as op

    late = "<!--" + " 0" * 3000 + "--><html class=x><HTML id='a' lang='de'><p>haus"
    assert op.markup_lang(late) == "de" and op.markup_lang("<html><p lang=de>") is None and op.markup_lang("<html " * 100_000) is None
    rows = [(i, "the cat and the house", "en") for i in range(20)] + [(100 + i, "der hund und das haus", "de") for i in range(20)] + [(200, late, None), (201, late.replace(" lang='de'", ""), None)]
    df = spark.createDataFrame(rows, "k long, body string, l string")
    by_key = {x.key: list(x.outside) for x in op.evidence(df, "k", "body", op.learn(df, "body", F.col("l")), F.col("l"), F.lit(None), F.lit(None)).collect()}
    assert by_key[200] == by_key[100] and by_key[201] == [0.0] * len(op.LANGUAGES)

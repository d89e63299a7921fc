def test_op4_row_block_of_many_classes(spark):
    import random

    from quillgraph.llm import op4_ngram_jaccard as op

    r = random.Random(1)
    texts = [" ".join(f"{r.randrange(1 << 20):x}" for _ in range(11)) + f" n{i}" for i in range(70_000)]
    near = [t + " end" for t in texts[65_000:]]
    one, other = (spark.createDataFrame([(i, t) for i, t in enumerate(part)], "id long, text string").coalesce(1) for part in (texts, near))
    found = {x.cls for x in op.candidates(one.unionByName(other), op.N, 3).collect()}
    want = {x.cls for x in op.name_sets(one.where("id >= 65000").unionByName(other), op.N).collect()}
    assert len(want) == 10_000 and found == want

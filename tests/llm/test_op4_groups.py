import random
from collections import Counter

from quillgraph.llm import op4_ngram_jaccard as op


def brute_force(sets):
    """Least index of each set's component, all pairs compared."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 4 * both >= 3 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.component_id for r in op.near_duplicates(df, "doc_id", "text").collect()}


def test_shared_paragraphs_without_links(spark):
    """2,000 documents of paragraphs that many share: long posting lists of classes that are all dense and mostly unlinked."""
    r = random.Random(2)
    paragraphs = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(40)]
    texts = [" ".join(r.sample(paragraphs, 6)) for _ in range(2000)]
    got = components(spark, texts)
    # Brute force by overlaps of paragraphs' inner shingles alone would miss the seams, so all pairs of a sample's sets are compared.
    want = brute_force([shingles(t) for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_passage_with_more_and_less_besides(spark):
    """Classes around the bounds: a common passage with 0 to 40 words of their own, so that links depend on both sizes."""
    passage = " ".join(f"w{i}" for i in range(100))
    texts = [passage + "".join(f" o{k}_{i}" for i in range(k % 41)) for k in range(300)]
    got = components(spark, texts)
    assert [got[i] for i in range(len(texts))] == brute_force([shingles(t) for t in texts])


def test_random_near_copies(spark):
    r = random.Random(11)
    texts = []
    for _ in range(25):
        base = [f"v{r.randint(0, 300)}" for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(1, 14)):
            copy = list(base)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 40)}"
            a = r.randint(0, 6)
            texts.append(" ".join(copy[a:]))
    got = components(spark, texts)
    assert [got[i] for i in range(len(texts))] == brute_force([shingles(t) for t in texts])


def test_keep_one_with_null_and_repeated_ids(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuv")
    near = t.replace("t59", "other")
    rows = [(1, t, 1), (None, near, 2), (7, u, 3), (7, v, 4), (7, v, 4), (None, "", 5), (None, "", 5), (9, None, 6), (None, "only null", 7), (None, "only null", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark long").withColumnRenamed("mark", "cls")
    kept = op.keep_one(df, "doc_id", "text")
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(1, t, 1), (7, u, 3), (7, v, 4), (None, "", 5), (None, "", 5), (9, None, 6), (None, "only null", 7)])

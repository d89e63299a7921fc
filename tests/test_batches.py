"""Proposals, batches, ledgers of events, staged views and gold anchors on odd rows."""

from quillgraph.operators import matching as M
from quillgraph.operators import tables as TB


def test_proposals_and_batches(spark):
    found = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), ("b", ["z"]), ("c", []), ("d", None)], "paper_id string, keys array<string>")
    known = spark.createDataFrame([("y",), ("y",), (None,)], "key string")
    fresh = TB.proposed(found, known, "2024-05-06")
    assert sorted(tuple(r) for r in fresh.collect()) == [(p, "batch-2024-05-06", "proposed") for p in ("b", "b", "c", "d")]
    old = spark.createDataFrame([("q", "batch-2024-05-06", "proposed", 7)], "paper_id string, batch string, status string, place int")
    assert sorted((r.place, r.paper_id) for r in TB.merged_batch(old, fresh).collect()) == [(7, "q"), (8, "b"), (9, "b"), (10, "c"), (11, "d")]
    assert TB.merged_batch(old.limit(0), fresh.limit(0)).collect() == []


def test_event_rows(spark):
    rows = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a"), ("s", 1, None)], "run_id string, at int, event string")
    first = TB.event_rows(rows, "at")
    assert sorted((r.event_id, r.event) for r in first.collect()) == [("r:e000001", "a"), ("r:e000002", "b"), ("s:e000001", None)]
    more = TB.event_rows(spark.createDataFrame([("r", 0, "c"), ("t", 0, "d")], rows.schema), "at", first)
    assert sorted((r.event_id, r.order) for r in more.collect()) == [("r:e000003", 3), ("t:e000001", 1)]


def test_staged(spark):
    papers = spark.createDataFrame([("p", "Title"), ("unused", "x")], "id string, title string")
    made = spark.createDataFrame([("c", "p", "short"), ("d", "q", "a  statement " * 9)], "id string, paper_id string, statement string")
    got = [tuple(r) for r in TB.staged(papers, made, spark.createDataFrame([("c", "d", "refines")], "src string, dst string, relation string"), 12).collect()]
    assert sorted(got, key=str) == sorted([(1, "p", "Title", None, None), (1, "q", "q", None, None), (2, "c", "short", None, None), (2, "d", "a statement…", None, None), (2, None, "stated_in", "c", "p"), (2, None, "stated_in", "d", "q"), (3, None, "refines", "c", "d")], key=str)


def test_gold_anchors(spark):
    schema = "id int, arxiv string, doi string, words array<string>"
    works = spark.createDataFrame([(1, "a", None, ["u"]), (2, "a", "d", ["u", "v"]), (3, None, None, ["u", "v"]), (4, None, None, None)], schema)
    gold = spark.createDataFrame([(10, "a", "d", []), (11, "none", "d", ["u", "v"]), (12, None, "d", []), (13, None, "other", ["u", "v"]), (14, None, None, ["u", "w", "x"]), (15, None, None, None)], schema)
    assert sorted(tuple(r) for r in M.gold_anchors(gold, works).collect()) == [(10, 1, "arxiv"), (12, 2, "doi"), (13, 2, "title")]

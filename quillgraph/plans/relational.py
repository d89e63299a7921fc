"""Filters, joins, aggregations, windows and set operations over the graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import dates as D
from quillgraph.functions import identity as I
from quillgraph.functions import stats as S
from quillgraph.functions import text as T
from quillgraph.plans.base import CITES, EDGES, PAPERS, WORKS, cites, edges, papers, table, works
from quillgraph.plans.registry import query

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
KEY = "trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"


@query("a01_summary", f"""WITH {CITES}, {EDGES} SELECT (SELECT count(*) FROM orders) AS papers, (SELECT count(*) FROM lineitem) AS contributions, (SELECT count(*) FROM edges) AS relations,
  (SELECT count(*) FROM cites) AS citations, (SELECT count(DISTINCT rel) FROM edges) AS relation_types, (SELECT count(DISTINCT o_custkey) FROM orders) AS collections""")
def a01(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the graph's parts, each from its own small aggregation."""
    one = lambda df, **k: df.agg(*[v.alias(n) for n, v in k.items()])
    parts = [
        one(works(spark, d), papers=F.count("*"), collections=F.count_distinct("collection")), one(table(spark, d, "lineitem"), contributions=F.count("*")),
        one(edges(spark, d), relations=F.count("*"), relation_types=F.count_distinct("rel")), one(cites(spark, d), citations=F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@query("a02_relation_counts", f"WITH {EDGES}, n AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus = 'F') SELECT rel, count(*) AS n FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) GROUP BY rel")
def a02(spark, d):
    """Relations by type with both ends in a set of nodes."""
    from quillgraph.operators.graph import with_both_ends

    nodes = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("node"))
    return with_both_ends(edges(spark, d), nodes).groupBy("rel").agg(F.count("*").alias("n"))


@query("a03_distributions", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def a03(spark, d):
    """All distributions in one scan, by grouping sets."""
    table(spark, d, "lineitem").createOrReplaceTempView("a03_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM a03_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")


@query("a04_annotation_tally", "SELECT quality AS target, count(*) AS n, sum(toxic)::BIGINT AS correct, (count(*) - sum(toxic))::BIGINT AS incorrect, max(CASE WHEN doc_id % 7 = 0 THEN toxic END) AS mine FROM labels GROUP BY quality")
def a04(spark, d):
    """Votes by target, and one annotator's own."""
    return table(spark, d, "labels").groupBy(F.col("quality").alias("target")).agg(F.count("*").alias("n"), F.sum("toxic").alias("correct"), (F.count("*") - F.sum("toxic")).alias("incorrect"), F.max(F.when(F.col("doc_id") % 7 == 0, F.col("toxic"))).alias("mine"))


@query("a05_label_sets", "SELECT doc_id % 50 AS target, max(CASE WHEN doc_id % 3 = 0 THEN quality END) AS judge, coalesce(list(toxic ORDER BY doc_id) FILTER (doc_id % 3 <> 0), []) AS humans FROM labels GROUP BY 1")
def a05(spark, d):
    """A judge's verdict and the list of human verdicts by target."""
    humans = F.transform(F.array_sort(F.collect_list(F.when(F.col("doc_id") % 3 != 0, F.struct("doc_id", "toxic")))), lambda x: x["toxic"])
    return table(spark, d, "labels").groupBy((F.col("doc_id") % 50).alias("target")).agg(F.max(F.when(F.col("doc_id") % 3 == 0, F.col("quality"))).alias("judge"), humans.alias("humans"))


@query("a07_majority_vote", """WITH c AS (SELECT l_partkey AS target, l_returnflag AS verdict, count(*) AS n, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2)
  SELECT target, verdict, n FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, first, verdict) AS r FROM c) WHERE r = 1""")
def a07(spark, d):
    """The most frequent verdict; of equals, the first seen."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("verdict")).agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first"))
    return c.groupBy("target").agg(F.min(F.struct(-F.col("n"), "first", "verdict")).alias("best"), F.min_by("n", F.struct(-F.col("n"), "first", "verdict")).alias("n")).select("target", "best.verdict", "n")


@query("a08_majority_share", "SELECT avg(CASE WHEN correct * 2 > n THEN 1.0 ELSE 0.0 END) AS share, count(*) AS targets FROM (SELECT l_partkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS correct FROM lineitem GROUP BY 1)")
def a08(spark, d):
    """Share of targets of which a strict majority says correct."""
    votes = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("correct"))
    return votes.agg(F.avg(F.when(F.col("correct") * 2 > F.col("n"), 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("targets"))


@query("a09_scorecard", """SELECT l_shipmode AS kind, n, self_rate, human_rate, CASE WHEN n = 0 THEN 'pending' WHEN self_rate >= 0.33 THEN 'pass' ELSE 'warn' END AS status FROM (
  SELECT l_linestatus AS l_shipmode, count(*) AS n, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS self_rate, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS human_rate FROM lineitem GROUP BY 1)""")
def a09(spark, d):
    """Rates by kind with a gate on each."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    x = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"), rate(F.col("l_returnflag") == "A").alias("self_rate"), rate(F.col("l_discount") > 0.05).alias("human_rate"))
    return x.withColumn("status", T.metric_status(F.col("self_rate"), 0.33))


@query("a10_pairwise_agreement", """WITH v AS (SELECT DISTINCT l_partkey AS item, l_suppkey % 10 AS judge, max(l_returnflag) OVER (PARTITION BY l_partkey, l_suppkey % 10) AS verdict FROM lineitem)
  SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS items, avg(CASE WHEN a.verdict = b.verdict THEN 1.0 ELSE 0.0 END) AS agreement FROM v a JOIN v b ON a.item = b.item AND a.judge < b.judge GROUP BY 1, 2""")
def a10(spark, d):
    """Agreement of each pair of judges on the items both judged."""
    v = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 10).alias("judge")).agg(F.max("l_returnflag").alias("verdict"))
    b = v.select(F.col("item").alias("item_b"), F.col("judge").alias("judge_b"), F.col("verdict").alias("verdict_b"))
    pairs = v.join(b, (F.col("item") == F.col("item_b")) & (F.col("judge") < F.col("judge_b")))
    return pairs.groupBy(F.col("judge").alias("judge_a"), "judge_b").agg(F.count("*").alias("items"), F.avg(F.when(F.col("verdict") == F.col("verdict_b"), 1.0).otherwise(0.0)).alias("agreement"))


@query("a11_collections", "SELECT c_custkey AS collection, c_name AS name, count(o_orderkey) AS papers FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def a11(spark, d):
    """Collections with their number of papers, also those without any."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("collection"), F.col("c_name").alias("name"), F.coalesce("k", F.lit(0)).alias("papers"))


@query("a12_degree", f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node")
def a12(spark, d):
    from quillgraph.operators.graph import degrees

    return degrees(edges(spark, d))


@query("a13_pair_weights", f"WITH {EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM edges WHERE src <> dst GROUP BY 1, 2")
def a13(spark, d):
    from quillgraph.operators.graph import pair_weights

    return pair_weights(edges(spark, d))


@query("a14_dominant_community", """WITH c AS (SELECT l_orderkey AS paper, l_suppkey % 9 AS community, count(*) AS n, min(l_linenumber * 10000 + l_partkey) AS first FROM lineitem GROUP BY 1, 2)
  SELECT paper, arg_min(community, (-n, first, community)) AS community, list_sort(list(DISTINCT community)) AS spread, count(*) >= 2 AS bridge FROM c GROUP BY paper""")
def a14(spark, d):
    """Each paper's most frequent community, all of its communities, and whether it bridges some (also F-13)."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), (F.col("l_suppkey") % 9).alias("community")).agg(F.count("*").alias("n"), F.min(F.col("l_linenumber") * 10000 + F.col("l_partkey")).alias("first"))
    return c.groupBy("paper").agg(F.min_by("community", F.struct(-F.col("n"), "first", "community")).alias("community"), F.sort_array(F.collect_set("community")).alias("spread"), (F.count("*") >= 2).alias("bridge"))


@query("a15_dominant_relation", f"""WITH {EDGES}, c AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, rel, count(*) AS n FROM edges WHERE src <> dst GROUP BY 1, 2, 3)
  SELECT a, b, arg_min(rel, (-n, rel)) AS rel, sum(n)::BIGINT AS n FROM c GROUP BY a, b""")
def a15(spark, d):
    c = edges(spark, d).where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "rel").agg(F.count("*").alias("n"))
    return c.groupBy("a", "b").agg(F.min_by("rel", F.struct(-F.col("n"), "rel")).alias("rel"), F.sum("n").alias("n"))


@query("a17_graph_stats", f"""WITH {EDGES}, g AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)
  SELECT (SELECT count(*) FROM edges) AS relations, (SELECT avg(CASE WHEN rel = 'contradicts' THEN 1.0 ELSE 0.0 END) FROM edges) AS contradiction_rate,
  (SELECT avg(CASE WHEN coalesce(k, 0) > 1 THEN 1.0 ELSE 0.0 END) FROM orders LEFT JOIN g ON node = o_orderkey) AS linked_rate""")
def a17(spark, d):
    from quillgraph.operators.graph import degrees

    e = edges(spark, d)
    linked = works(spark, d).join(degrees(e), F.col("id") == F.col("node"), "left").agg(F.avg(F.when(F.coalesce("degree", F.lit(0)) > 1, 1.0).otherwise(0.0)).alias("linked_rate"))
    return e.agg(F.count("*").alias("relations"), F.avg(F.when(F.col("rel") == "contradicts", 1.0).otherwise(0.0)).alias("contradiction_rate")).crossJoin(linked)


@query("a19_confusion", """WITH m AS (SELECT toxic AS gold, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS predicted FROM labels JOIN documents USING (doc_id)), c AS (SELECT gold AS label, count(*) FILTER (predicted = gold) AS tp, count(*) AS golds FROM m GROUP BY 1),
  p AS (SELECT predicted AS label, count(*) AS predictions FROM m GROUP BY 1)
  SELECT label, coalesce(tp, 0) AS tp, coalesce(golds, 0) AS golds, coalesce(predictions, 0) AS predictions, CASE WHEN golds + predictions > 0 THEN 2.0 * coalesce(tp, 0) / (coalesce(golds, 0) + coalesce(predictions, 0)) ELSE 0 END AS f1 FROM c FULL JOIN p USING (label)""")
def a19(spark, d):
    """Counts and F1 by label; macro F1 is their mean."""
    m = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("toxic").alias("gold"), F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("predicted"))
    sides = m.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col("gold") == F.col("predicted")).cast("int").alias("t")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))).alias("x"))
    c = sides.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.t").alias("tp"), F.sum("x.g").alias("golds"), F.sum("x.p").alias("predictions"))
    return c.withColumn("f1", F.lit(2.0) * F.col("tp") / (F.col("golds") + F.col("predictions")))


@query("a20_budget_recall", """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), f AS (SELECT user_id, min(pos) AS pos FROM r WHERE event_type = 'purchase' GROUP BY 1)
  SELECT budget, count(pos) FILTER (pos <= budget) AS found, (count(pos) FILTER (pos <= budget))::DOUBLE / count(pos) AS recall FROM f CROSS JOIN (SELECT unnest([50, 100, 250, 500]) AS budget) GROUP BY budget""")
def a20(spark, d):
    """Gold items found within the first so many records. The position is counted by range partitions, not in one task."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    most = 500
    # Only the first `most` records count, so their positions are a bounded top-k.
    first = e.orderBy("ts", "event_id").limit(most).withColumn("at", F.row_number().over(W.orderBy("ts", "event_id")))
    golds = e.where("event_type = 'purchase'").agg(F.count_distinct("user_id").alias("golds"))
    found = first.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("at").alias("at"))
    budgets = spark.createDataFrame([(b,) for b in (50, 100, 250, 500)], "budget int")
    hits = budgets.join(F.broadcast(found), F.col("at") <= F.col("budget"), "left").groupBy("budget").agg(F.count("at").alias("found"))
    return hits.crossJoin(golds).select("budget", "found", (F.col("found") / F.col("golds")).alias("recall"))


@query("a21_branch_growth", """WITH f AS (SELECT user_id, min(event_type) AS first_branch FROM (SELECT user_id, event_type FROM events) GROUP BY 1), b AS (SELECT event_type AS branch, count(*) AS returned, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
  n AS (SELECT first_branch AS branch, count(*) AS new FROM f GROUP BY 1) SELECT branch, returned, coalesce(new, 0) AS new, users - coalesce(new, 0) AS rediscovered, (sum(coalesce(new, 0)) OVER (ORDER BY branch))::BIGINT AS corpus FROM b LEFT JOIN n USING (branch)""")
def a21(spark, d):
    """By branch in order: returned, first seen there, seen before, and the corpus so far."""
    e = table(spark, d, "events")
    first = e.groupBy("user_id").agg(F.min("event_type").alias("branch")).groupBy("branch").agg(F.count("*").alias("new"))
    b = e.groupBy(F.col("event_type").alias("branch")).agg(F.count("*").alias("returned"), F.count_distinct("user_id").alias("users")).join(first, "branch", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return b.select("branch", "returned", "new", (F.col("users") - F.col("new")).alias("rediscovered"), F.sum("new").over(W.orderBy("branch")).alias("corpus"))


@query("a22_channel_counts", "SELECT event_type AS channel, count(*) AS n FROM events GROUP BY 1")
def a22(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))


@query("a23_by_year", "SELECT year(o_orderdate)::INT AS year, o_orderstatus AS type, count(*) AS n FROM orders GROUP BY 1, 2")
def a23(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("type")).agg(F.count("*").alias("n"))


@query("a24_distinctive_terms", f"""WITH t AS (SELECT DISTINCT doc_id, lang, unnest({TOKENS.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS total FROM documents), s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1),
  i AS (SELECT lang, term, count(*) AS df_in FROM t GROUP BY 1, 2), a AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
  l AS (SELECT lang, term, df_in, (df_in::DOUBLE / size) / (df::DOUBLE / total) AS lift FROM i JOIN a USING (term) JOIN s USING (lang) CROSS JOIN n WHERE df_in >= 3)
  SELECT lang, term, df_in, lift FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(lift, 9) DESC, df_in DESC, term) AS r FROM l WHERE lift > 1.2) WHERE r <= 12""")
def a24(spark, d):
    """Terms by group with their lift over the whole corpus."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    sizes = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    inside = docs.groupBy("lang", "term").agg(F.count("*").alias("df_in"))
    whole = inside.groupBy("term").agg(F.sum("df_in").alias("df"))
    lift = inside.where("df_in >= 3").join(whole, "term").join(F.broadcast(sizes), "lang").crossJoin(F.broadcast(total)).withColumn("lift", (F.col("df_in") / F.col("size")) / (F.col("df") / F.col("total"))).where("lift > 1.2")
    order = W.partitionBy("lang").orderBy(F.desc(F.round("lift", 9)), F.desc("df_in"), "term")
    return lift.withColumn("r", F.row_number().over(order)).where("r <= 12").select("lang", "term", "df_in", "lift")


@query("a25_size_buckets", "SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 7 THEN '5-7' ELSE '8+' END AS bucket, count(*) AS communities, sum(n)::BIGINT AS members FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def a25(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") == 1, "1").when(F.col("n") <= 4, "2-4").when(F.col("n") <= 7, "5-7").otherwise("8+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("communities"), F.sum("n").alias("members"))


@query("a26_suspect_edges", f"WITH {EDGES} SELECT rel, count(*) FILTER (similarity < 0.3) AS suspect, count(*) AS n FROM edges GROUP BY ROLLUP (rel)")
def a26(spark, d):
    """Suspect relations by type with totals, by rollup."""
    return edges(spark, d).rollup("rel").agg(F.count_if(F.col("similarity") < 0.3).alias("suspect"), F.count("*").alias("n"))


@query("a28_citation_union", f"""WITH {CITES}, {EDGES}, u AS (SELECT src, dst, 'record' AS channel FROM cites UNION ALL SELECT src, dst, 'text' FROM edges WHERE src <> dst)
  SELECT src, dst, list_sort(list(DISTINCT channel)) AS channels FROM u GROUP BY src, dst""")
def a28(spark, d):
    """Union of edge sets with the channels each edge came by (also U-04)."""
    u = cites(spark, d).withColumn("channel", F.lit("record")).unionByName(edges(spark, d).where("src <> dst").select("src", "dst", F.lit("text").alias("channel")))
    return u.groupBy("src", "dst").agg(F.sort_array(F.collect_set("channel")).alias("channels"))


@query("a29_state_counts", "SELECT o_orderstatus AS state, o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY 1, 2")
def a29(spark, d):
    """Counts by state and severity (also A-30)."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"))


@query("a31_thresholds", "SELECT count(*) FILTER (l_discount >= 0.09) AS ge_9, count(*) FILTER (l_discount >= 0.06) AS ge_6, count(*) FILTER (l_discount >= 0.03) AS ge_3, median(l_extendedprice) AS median FROM lineitem")
def a31(spark, d):
    ge = lambda x: F.count_if(F.col("l_discount") >= x)
    return table(spark, d, "lineitem").agg(ge(0.09).alias("ge_9"), ge(0.06).alias("ge_6"), ge(0.03).alias("ge_3"), F.median("l_extendedprice").alias("median"))


@query("a32_session_counts", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def a32(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


@query("a33_first_wins", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def a33(spark, d):
    """The first record of each key (also W-15, R-14): an aggregate, not a sort."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_type", "x.event_id")


@query("a35_cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a35(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("a37_annotators", "SELECT l_suppkey % 10 AS annotator, count(*) AS n FROM lineitem GROUP BY 1")
def a37(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("annotator")).agg(F.count("*").alias("n"))


@query("a38_latest_decision", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS decision FROM events GROUP BY user_id")
def a38(spark, d):
    """The last decision of each key (also S-05)."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"))


REVIEWS = "CASE WHEN doc_id % 11 = 0 THEN 'Review' END"
REVIEW_TITLE = "CASE doc_id % 5 WHEN 0 THEN 'A survey of ' WHEN 1 THEN 'Preview of ' WHEN 2 THEN 'Notes: a review. ' ELSE '' END || coalesce(substr(text, 1, 60), '')"


@query("f01_review_filter", rf"SELECT doc_id FROM documents WHERE lower({REVIEWS}) = 'review' OR regexp_matches({REVIEW_TITLE}, '\bsurvey\b|\bsystematic review\b|\b(a|comprehensive) review\b|\breview of\b|:\s*a review\b|\boverview of\b', 'i')")
def f01(spark, d):
    """Reviews by their type, or by their title; types and beginnings of titles are made from the id."""
    return table(spark, d, "documents").where(T.is_review(F.expr(REVIEWS), F.expr(REVIEW_TITLE))).select("doc_id")


@query("f03_abstract_suspect", f"""WITH {PAPERS}, t AS (SELECT id, list_distinct(list_filter({TOKENS.format('title')}, lambda x: length(x) >= 4)) AS a, {TOKENS.format('substr(text, 61)')} AS b FROM papers)
  SELECT id, len(a) AS terms, len(list_filter(a, lambda x: list_contains(b, x))) AS shared FROM t WHERE len(a) > 0 AND len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) < 0.12""")
def f03(spark, d):
    """Texts that hardly share their title's salient terms."""
    t = papers(spark, d).select("id", T.salient(F.col("title")).alias("a"), T.tokens(F.expr("substring(text, 61)")).alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return t.where((F.size("a") > 0) & (shared / F.size("a") < 0.12)).select("id", F.size("a").cast("long").alias("terms"), shared.cast("long").alias("shared"))


@query("f06_cutoff", f"WITH {WORKS} SELECT id FROM works WHERE year IS NULL OR year <= 1996")
def f06(spark, d):
    return works(spark, d).where("year IS NULL OR year <= 1996").select("id")


@query("f07_render_filter", f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE confidence >= 0.7 AND coalesce(year, 0) <= 1999), g AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
  n AS (SELECT node FROM g ORDER BY k DESC, node LIMIT 500) SELECT src, dst, rel, count(*) AS n FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) GROUP BY ALL""")
def f07(spark, d):
    """Trusted relations up to a year among the 500 nodes of highest degree."""
    from quillgraph.operators.graph import degrees, with_both_ends

    e = edges(spark, d).where((F.col("confidence") >= 0.7) & (F.coalesce("year", F.lit(0)) <= 1999))
    nodes = degrees(e).orderBy(F.desc("degree"), "node").limit(500).select("node")
    return with_both_ends(e, F.broadcast(nodes)).groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))


@query("f15_dense_judges", "SELECT l_suppkey AS judge, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (3, 5) GROUP BY 1 HAVING count(*) >= 10")
def f15(spark, d):
    return table(spark, d, "lineitem").where(~F.col("l_suppkey").isin(3, 5)).groupBy(F.col("l_suppkey").alias("judge")).agg(F.count("*").alias("n")).where("n >= 10")


@query("f16_hub_safety_net", f"WITH {CITES} SELECT o_orderkey AS id, n FROM orders JOIN (SELECT dst, count(*) AS n FROM cites GROUP BY 1) ON dst = o_orderkey WHERE o_orderstatus = 'P' AND n >= 2 ORDER BY n DESC, id LIMIT 10")
def f16(spark, d):
    """Dropped papers that many cite."""
    n = cites(spark, d).groupBy("dst").agg(F.count("*").alias("n"))
    return table(spark, d, "orders").where("o_orderstatus = 'P'").join(n, F.col("o_orderkey") == F.col("dst")).where("n >= 2").select(F.col("o_orderkey").alias("id"), "n").orderBy(F.desc("n"), "id").limit(10)


@query("j01_citation_link", f"WITH {CITES} SELECT src, dst, a.year - b.year AS gap FROM cites JOIN (SELECT o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders) a ON a.id = src JOIN (SELECT o_orderkey AS id, year(o_orderdate)::INT AS year FROM orders) b ON b.id = dst")
def j01(spark, d):
    w = works(spark, d)
    return cites(spark, d).join(w.select(F.col("id").alias("src"), F.col("year").alias("ya")), "src").join(w.select(F.col("id").alias("dst"), F.col("year").alias("yb")), "dst").select("src", "dst", (F.col("ya") - F.col("yb")).alias("gap"))


@query("j02_corpus_index", f"WITH {PAPERS}, k AS (SELECT id, {KEY.format('title')} AS t FROM papers) SELECT t AS key, min(id) AS id, count(*) AS n FROM k WHERE length(t) >= 8 GROUP BY t")
def j02(spark, d):
    """Title index: the first paper of each key."""
    return papers(spark, d).select("id", I.title_key(F.col("title")).alias("key")).where(F.length("key") >= I.LEAST_TITLE).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("j03_prioritised_match", """SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, min(coalesce(CASE WHEN p_size > 40 THEN 'size:' || p_partkey END, CASE WHEN s_acctbal > 5000 THEN 'balance:' || s_suppkey END, 'order:' || o_orderkey)) AS target
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""")
def j03(spark, d):
    """The first axis that matches wins."""
    a = table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("size:"), "p_partkey").alias("a"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("balance:"), "s_suppkey").alias("b"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("order:"), "o_orderkey").alias("c"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(a, "l_partkey", "left").join(b, "l_suppkey", "left").join(c, "l_orderkey", "left")
    return x.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"), F.min(F.coalesce("a", "b", "c")).alias("target"))


@query("j04_resolve_and_link", f"WITH {CITES}, {EDGES} SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM cites)")
def j04(spark, d):
    """New edges: no loops, none that exist, each pair once."""
    return edges(spark, d).where("src <> dst").select("src", "dst").distinct().join(cites(spark, d), ["src", "dst"], "left_anti")


@query("j11_duplicate_finder", f"""WITH {PAPERS}, k AS (SELECT id, {KEY.format('title')} AS t FROM papers), f AS (SELECT t, min(id) AS first FROM k WHERE length(t) >= 8 GROUP BY t)
  SELECT k.id, f.first AS duplicate_of, 'title' AS kind FROM k JOIN f USING (t) WHERE f.first <> k.id""")
def j11(spark, d):
    k = papers(spark, d).select("id", I.title_key(F.col("title")).alias("t")).where(F.length("t") >= I.LEAST_TITLE)
    first = k.groupBy("t").agg(F.min("id").alias("duplicate_of"))
    return k.join(first, "t").where("duplicate_of <> id").select("id", "duplicate_of", F.lit("title").alias("kind"))


@query("j12_child_counts", "SELECT o_orderkey AS id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS contributions, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS claims FROM orders")
def j12(spark, d):
    """Children by paper: one aggregation before the join, so no cross product."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    return table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.coalesce("a", F.lit(0)).alias("contributions"), F.coalesce("b", F.lit(0)).alias("claims"))


@query("j15_detail", "SELECT l_orderkey AS id, list_sort(list(l_partkey * 10 + l_linenumber)) AS claims FROM lineitem GROUP BY 1")
def j15(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.col("l_partkey") * 10 + F.col("l_linenumber"))).alias("claims"))


@query("j17_remaining", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17(spark, d):
    """What is not judged yet (also R-09)."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("j22_mutual_unique", f"WITH {EDGES}, p AS (SELECT DISTINCT src, dst FROM edges) SELECT src, dst FROM (SELECT *, count(*) OVER (PARTITION BY src) AS a, count(*) OVER (PARTITION BY dst) AS b FROM p) WHERE a = 1 AND b = 1")
def j22(spark, d):
    """Pairs of which neither end is in another pair."""
    p = edges(spark, d).select("src", "dst").distinct()
    a, b = p.groupBy("src").count().where("count = 1").select("src"), p.groupBy("dst").count().where("count = 1").select("dst")
    return p.join(a, "src", "left_semi").join(b, "dst", "left_semi")


@query("j26_best_title_match", f"""WITH w AS (SELECT p_partkey AS id, list_distinct({TOKENS.format("p_name || ' ' || p_type || ' ' || p_brand")}) AS ws FROM part), n AS (SELECT p_partkey AS id, list_distinct({TOKENS.format("p_name || ' ' || p_type || ' ' || p_brand")}) AS ws FROM part WHERE p_partkey % 50 = 0),
  s AS (SELECT n.id AS a_id, w.id AS b_id, len(list_intersect(n.ws, w.ws))::DOUBLE / len(list_distinct(list_concat(n.ws, w.ws))) AS jaccard FROM n JOIN w ON n.id <> w.id)
  SELECT a_id, b_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY jaccard DESC, b_id) AS r FROM s WHERE jaccard >= 0.6) WHERE r = 1""")
def j26(spark, d):
    """Best match among all parts of those whose id is divisible by 50, by Jaccard of at least 0.6."""
    from quillgraph.operators.retrieval import by_jaccard, closest

    words = F.array_distinct(T.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand")))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("id"), words.alias("words"))
    return closest(part.where("id % 50 = 0"), part, by_jaccard, lambda s: s >= 0.6, apart=True).withColumnRenamed("score", "jaccard")


@query("j20_containment_scan", "WITH b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1 - doc_id, substr(text, instr(text, ' '), 40) FROM documents WHERE doc_id % 50 = 0) SELECT doc_id, item_id FROM documents JOIN b ON length(b.text) >= 25 AND contains(documents.text, b.text)")
def j20(spark, d):
    """Documents that contain a benchmark text, or a passage of 40 characters of a document whose id is divisible by 50."""
    from quillgraph.operators.retrieval import containing

    docs = table(spark, d, "documents")
    own = docs.where("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("item_id"), F.expr("substr(text, instr(text, ' '), 40)").alias("text"))
    return containing(docs, table(spark, d, "benchmark").select("item_id", "text").unionByName(own))


@query("e02_dedup_by_key", f"WITH {PAPERS}, k AS (SELECT id, source, {KEY.format('title')} AS t FROM papers) SELECT arg_min(id, id) AS id, arg_min(source, id) AS source FROM k GROUP BY CASE WHEN length(t) >= 8 THEN 'title:' || t ELSE id::VARCHAR END")
def e02(spark, d):
    """The first record of each key."""
    p = papers(spark, d).select("id", "source", I.key(F.col("title"), F.col("id").cast("string")).alias("k"))
    return p.groupBy("k").agg(F.min("id").alias("id"), F.min_by("source", "id").alias("source")).drop("k")


@query("e06_work_duplicates", f"WITH {PAPERS}, k AS (SELECT id, {KEY.format('title')} AS t FROM papers) SELECT 'work:' || substr(sha1('title:' || t), 1, 16) AS work, count(*) AS n FROM k WHERE length(t) >= 8 GROUP BY t HAVING count(*) > 1")
def e06(spark, d):
    p = papers(spark, d).select(I.work_id(F.col("title"), F.col("id").cast("string")).alias("work"))
    return p.where(F.col("work").startswith("work:")).groupBy("work").agg(F.count("*").alias("n")).where("n > 1")


@query("e08_dedup_observer", f"WITH {PAPERS}, k AS (SELECT id, source, {KEY.format('title')} AS t FROM papers) SELECT t AS key, min(id) AS retained, list_sort(list(DISTINCT source)) AS variants FROM k WHERE length(t) >= 8 GROUP BY t")
def e08(spark, d):
    p = papers(spark, d).select("id", "source", I.title_key(F.col("title")).alias("key")).where(F.length("key") >= I.LEAST_TITLE)
    return p.groupBy("key").agg(F.min("id").alias("retained"), F.sort_array(F.collect_set("source")).alias("variants"))


@query("w03_foundational_order", f"WITH {CITES}, {WORKS} SELECT id, n, year FROM (SELECT id, year, coalesce(n, 0) AS n FROM works LEFT JOIN (SELECT dst, count(*) AS n FROM cites GROUP BY 1) ON dst = id) ORDER BY n DESC, coalesce(year, 9999), id LIMIT 25")
def w03(spark, d):
    n = cites(spark, d).groupBy("dst").agg(F.count("*").alias("k"))
    w = works(spark, d).join(n, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("k", F.lit(0)).alias("n"), "year")
    return w.orderBy(F.desc("n"), F.coalesce("year", F.lit(9999)), "id").limit(25)


@query("w05_high_yield_seeds", f"""WITH {CITES}, {WORKS}, n AS (SELECT id, date, coalesce(k, 0) AS k FROM works LEFT JOIN (SELECT dst, count(*) AS k FROM cites GROUP BY 1) ON dst = id),
  a AS (SELECT id FROM n ORDER BY k DESC, id LIMIT 40), b AS (SELECT id FROM n ORDER BY date DESC, id LIMIT 60) SELECT id, min(way) AS way FROM (SELECT id, 'cited' AS way FROM a UNION ALL SELECT id, 'recent' FROM b) GROUP BY id""")
def w05(spark, d):
    """The most cited and the most recent, each once."""
    n = cites(spark, d).groupBy("dst").agg(F.count("*").alias("k"))
    w = works(spark, d).join(n, F.col("id") == F.col("dst"), "left").select("id", "date", F.coalesce("k", F.lit(0)).alias("k"))
    both = w.orderBy(F.desc("k"), "id").limit(40).select("id", F.lit("cited").alias("way")).unionByName(w.orderBy(F.desc("date"), "id").limit(60).select("id", F.lit("recent").alias("way")))
    return both.groupBy("id").agg(F.min("way").alias("way"))


@query("w07_quantile_gate", "SELECT l_orderkey, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r, count(*) OVER (PARTITION BY l_suppkey) AS c FROM lineitem) WHERE l_discount >= 2 * l_tax OR r <= greatest(1, floor(c * 0.3)) GROUP BY 1")
def w07(spark, d):
    """Kept: what scores in above out, or is in the top three tenths of its group."""
    g = W.partitionBy("l_suppkey")
    x = table(spark, d, "lineitem").withColumn("r", F.row_number().over(g.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"))).withColumn("c", F.count("*").over(g))
    return x.where((F.col("l_discount") >= 2 * F.col("l_tax")) | (F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("c") * 0.3)))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("w08_top_per_group", "SELECT l_orderkey, list(l_partkey ORDER BY l_extendedprice DESC, l_partkey) AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS r FROM lineitem) WHERE r <= 3 GROUP BY 1")
def w08(spark, d):
    top = table(spark, d, "lineitem").withColumn("r", F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey"))).where("r <= 3")
    return top.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "l_partkey"))), lambda x: x["l_partkey"]).alias("best"))


@query("w09_best_representation", "SELECT source, arg_max(doc_id, (n_chars, length(text), doc_id)) AS best FROM documents GROUP BY source")
def w09(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", F.length("text").alias("l"), "doc_id")).alias("best"))


@query("w12_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('seed' || o_orderkey), o_orderkey LIMIT 20")
def w12(spark, d):
    """A reproducible sample: the smallest hashes."""
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.md5(F.concat(F.lit("seed"), F.col("o_orderkey").cast("string"))), "o_orderkey").limit(20)


@query("w13_community_order", "SELECT o_custkey AS community, n, row_number() OVER (ORDER BY n DESC, least) - 1 AS place FROM (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS least FROM orders GROUP BY 1) WHERE n >= 8 ORDER BY place LIMIT 9")
def w13(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("community")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least")).where("n >= 8").orderBy(F.desc("n"), "least").limit(9)
    return n.select("community", "n", (F.row_number().over(W.orderBy(F.desc("n"), "least")) - 1).cast("long").alias("place"))


@query("w16_average_rank", "SELECT p_size, count(*) AS n, min(r) + (count(*) - 1) / 2.0 AS rank FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) AS r FROM part) GROUP BY p_size")
def w16(spark, d):
    """Ranks with ties averaged, from counts by value."""
    n = table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("p_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return n.select("p_size", "n", (before + (F.col("n") + 1) / 2).alias("rank"))


@query("w17_contiguity", "SELECT conv_id, count(*) = max(turn) - min(turn) + 1 AND min(turn) = 0 AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def w17(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(((F.count("*") == F.max("turn") - F.min("turn") + 1) & (F.min("turn") == 0) & (F.count_distinct("turn") == F.count("*"))).alias("contiguous"))


@query("u02_overlap", "SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'click') AS a, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'purchase') AS b, (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')) AS common")
def u02(spark, d):
    """Two key sets and their intersection, in one pass over the keys."""
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max((F.col("event_type") == "click").cast("int")).alias("a"), F.max((F.col("event_type") == "purchase").cast("int")).alias("b"))
    return seen.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("common"))


@query("u03_difference", "SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def u03(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'purchase'").select("user_id").subtract(e.where("event_type = 'error'").select("user_id"))


@query("k01_upsert", "SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.price ELSE o.price END AS price, n.id IS NOT NULL AS fresh FROM (SELECT p_partkey AS id, p_retailprice AS price FROM part WHERE p_size <= 30) o FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 > 0 THEN p_retailprice * 2 END AS price FROM part WHERE p_size >= 25) n ON o.id = n.id")
def k01(spark, d):
    from quillgraph.operators.tables import upsert

    p = table(spark, d, "part")
    old, new = p.where("p_size <= 30").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), p.where("p_size >= 25").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_retailprice") * 2).alias("price"))
    return upsert(old, new, ["id"], mark="fresh")


@query("k03_bulk_load", f"WITH {EDGES} SELECT DISTINCT src, dst, rel FROM edges WHERE rel IN ('supports', 'builds_on')")
def k03(spark, d):
    from quillgraph.operators.tables import bulk_edges

    return bulk_edges(edges(spark, d).select("src", "dst", "rel"), ("supports", "builds_on"))


@query("k04_dangling", f"WITH {EDGES}, n AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus <> 'P') SELECT src, dst, count(*) AS n FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) GROUP BY 1, 2")
def k04(spark, d):
    from quillgraph.operators.graph import with_both_ends

    nodes = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("node"))
    return with_both_ends(edges(spark, d), nodes).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("k12_first_turn_title", "SELECT conv_id, arg_min(substr(text, 1, 40), turn) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def k12(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by(F.substring("text", 1, 40), "turn").alias("title"))


@query("m01_capture_recapture", """WITH c AS (SELECT count(DISTINCT user_id) FILTER (event_type = 'click') AS a, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS b FROM events),
  o AS (SELECT count(*) AS m FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')),
  e AS (SELECT a + b - m AS observed, (a + 1.0::DOUBLE) * (b + 1) / (m + 1) - 1 AS estimate, (a + 1.0::DOUBLE) * (b + 1) * (a - m) * (b - m) / ((m + 1.0::DOUBLE) * (m + 1) * (m + 2)) AS variance FROM c, o)
  SELECT observed, greatest(estimate, observed) AS estimate, greatest(estimate - 1.96 * sqrt(variance), observed) AS low, estimate + 1.96 * sqrt(variance) AS high, least(observed / estimate, 1.0) AS recall FROM e""")
def m01(spark, d):
    x = u02(spark, d)
    c = S.capture_recapture(F.col("a"), F.col("b"), F.col("common"))
    return x.select(*[v.alias(n) for n, v in c.items()])


@query("m03_consensus", f"WITH {EDGES} SELECT src, dst, rel, max(round((0.7::DOUBLE * confidence + 0.3::DOUBLE * similarity)::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE) AS trust, min(CASE WHEN confidence >= 0.65 AND similarity >= 0.5 THEN 'triple' WHEN confidence >= 0.65 OR similarity >= 0.5 THEN 'double' ELSE 'single' END) AS tier FROM edges GROUP BY 1, 2, 3")
def m03(spark, d):
    e = edges(spark, d)
    return e.groupBy("src", "dst", "rel").agg(F.max(S.single_trust(F.col("confidence"), F.col("similarity"))).alias("trust"), F.min(S.single_tier(F.col("confidence"), F.col("similarity"))).alias("tier"))


@query("m05_auc", """WITH x AS (SELECT n_chars AS s, toxic FROM labels JOIN documents USING (doc_id)), r AS (SELECT s, toxic, avg(rn) OVER (PARTITION BY s) AS rank FROM (SELECT *, row_number() OVER (ORDER BY s) AS rn FROM x))
  SELECT sum(toxic)::BIGINT AS positives, (count(*) - sum(toxic))::BIGINT AS negatives, (sum(rank * toxic) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * (count(*) - sum(toxic))) AS auc FROM r""")
def m05(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.auc(x, "n_chars", "toxic")


@query("m06_reliability", "SELECT least(floor(l_discount * 100 / 11.0 * 10), 9)::INT AS bin, count(*) AS n, avg(l_discount * 100 / 11.0) AS mean_score, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS accuracy FROM lineitem GROUP BY 1")
def m06(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_discount") * 100 / 11.0).alias("score"), (F.col("l_returnflag") == "A").cast("int").alias("label"))
    return S.reliability(x, "score", "label")


@query("d03_precision_compare", f"WITH {CITES}, {WORKS} SELECT src, dst, CASE WHEN left(a.date, 7) < left(b.date, 7) THEN -1 WHEN left(a.date, 7) > left(b.date, 7) THEN 1 ELSE 0 END::INT AS comparison FROM cites JOIN works a ON a.id = src JOIN works b ON b.id = dst")
def d03(spark, d):
    """Dates compared at the coarser precision of the two."""
    w = works(spark, d)
    x = cites(spark, d).join(w.select(F.col("id").alias("src"), F.col("date").alias("a")), "src").join(w.select(F.col("id").alias("dst"), F.substring("date", 1, 7).alias("b")), "dst")
    return x.select("src", "dst", D.compare(F.col("a"), F.col("b")).alias("comparison"))


@query("d04_orient_edges", f"WITH {EDGES}, {WORKS}, x AS (SELECT src, dst, a.date AS da, b.date AS db FROM edges JOIN works a ON a.id = src JOIN works b ON b.id = dst WHERE src <> dst) SELECT DISTINCT CASE WHEN da < db THEN dst ELSE src END AS newer, CASE WHEN da < db THEN src ELSE dst END AS older, da <> db AS directed FROM x")
def d04(spark, d):
    """From the newer to the older; equal dates are undirected."""
    w = works(spark, d)
    x = edges(spark, d).where("src <> dst").join(w.select(F.col("id").alias("src"), F.col("date").alias("da")), "src").join(w.select(F.col("id").alias("dst"), F.col("date").alias("db")), "dst")
    swap = D.compare(F.col("da"), F.col("db")) < 0
    return x.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("newer"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("older"), (F.col("da") != F.col("db")).alias("directed")).distinct()


@query("d06_fractional_year", "SELECT o_orderkey, year(o_orderdate) + (month(o_orderdate) - 1) / 12.0::DOUBLE AS fractional FROM orders")
def d06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.fractional_year(F.col("o_orderdate")).alias("fractional"))


@query("x01_title_key", f"WITH {PAPERS} SELECT id, {KEY.format('title')} AS title_key FROM papers")
def x01(spark, d):
    return papers(spark, d).select("id", I.title_key(F.coalesce("title", F.lit(""))).alias("title_key"))


@query("x08_head_and_tail", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 350) || chr(10) || '[...]' || chr(10) || right(text, 150) END AS window FROM documents")
def x08(spark, d):
    return table(spark, d, "documents").select("doc_id", T.head_and_tail(F.col("text"), 500).alias("window"))


@query("x20_tokens", f"SELECT doc_id, len({TOKENS.format('text')}) AS tokens, len(list_distinct({TOKENS.format('text')})) AS kinds FROM documents")
def x20(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("kinds"))


@query("x22_hash_ids", "SELECT o_orderkey, sha1(o_orderkey::VARCHAR) AS sha1, sha256(o_orderkey::VARCHAR) AS sha256 FROM orders")
def x22(spark, d):
    k = F.col("o_orderkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", F.sha1(k).alias("sha1"), F.sha2(k, 256).alias("sha256"))


@query("x23_occurrences", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def x23(spark, d):
    return table(spark, d, "documents").select("doc_id", T.occurrences(F.col("text"), "the").alias("n"))


@query("t12_sentences", "SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[.!?]+\\s+'), lambda x: x <> '')) AS sentence FROM documents")
def t12(spark, d):
    """A row for each sentence."""
    s = F.filter(F.split("text", r"[.!?]+\s+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.explode(s).alias("sentence"))


@query("v08_coverage", f"WITH {PAPERS}, t AS (SELECT id, {TOKENS.format('title')} AS a, {TOKENS.format('substr(text, 61)')} AS b FROM papers) SELECT id, CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a) ELSE 0.0 END AS coverage FROM t")
def v08(spark, d):
    p = papers(spark, d)
    words = p.select("id", T.tokens(F.col("title")).alias("a"), T.tokens(F.expr("substring(text, 61)")).alias("b"))
    return words.select("id", T.coverage(F.col("a"), F.col("b")).alias("coverage"))

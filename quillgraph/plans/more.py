"""Further filters, joins and aggregations of the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import identity as I
from quillgraph.functions import text as T
from quillgraph.plans.base import CITES, EDGES, WORKS, cites, edges, table, works
from quillgraph.plans.registry import query


@query("f04_registrant_prefix", "SELECT p_partkey FROM part WHERE split_part(p_brand, '#', 2) IN ('1', '13', '17')")
def f04(spark, d):
    """A registrant's prefix in a fixed set."""
    return table(spark, d, "part").where(F.substring_index("p_brand", "#", -1).isin("1", "13", "17")).select("p_partkey")


@query("f05_selectors", "SELECT o_orderkey, 'core' AS kind FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def f05(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.join(li, "o_orderkey", "left_semi").withColumn("kind", F.lit("core")).unionByName(o.join(li, "o_orderkey", "left_anti").withColumn("kind", F.lit("missing")))


@query("f08_contribution_graph", f"WITH {EDGES}, n AS (SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_returnflag IN ('A', 'N')) SELECT rel, count(*) AS n, count(DISTINCT src) AS papers FROM edges WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) GROUP BY rel")
def f08(spark, d):
    from quillgraph.operators.graph import with_both_ends

    nodes = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "N")).select(F.col("l_orderkey").alias("node"))
    return with_both_ends(edges(spark, d), nodes).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("papers"))


@query("f11_visibility", "SELECT doc_id FROM labels WHERE doc_id % 7 = 3 OR quality = 1")
def f11(spark, d):
    return table(spark, d, "labels").where((F.col("doc_id") % 7 == 3) | (F.col("quality") == 1)).select("doc_id")


@query("f12_anchor_filter", f"WITH {WORKS} SELECT id FROM works WHERE year >= 1998 OR starts_with(id::VARCHAR, '12')")
def f12(spark, d):
    return works(spark, d).where((F.col("year") >= 1998) | F.col("id").cast("string").startswith("12")).select("id")


@query("f14_calibration_rows", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_discount IS NOT NULL GROUP BY 1, 2")
def f14(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & F.col("l_discount").isNotNull()).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("f17_core_rule", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size > 10")
def f17(spark, d):
    return table(spark, d, "part").where("p_type = 'ECONOMY' AND p_size > 10").select("p_partkey")


@query("j10_work_existence", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) OR c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def j10(spark, d):
    """Known by id or by a shared alias: semi-joins united."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    by_id = c.join(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_semi")
    by_alias = c.join(table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi")
    return by_id.select("id").union(by_alias.select("id")).distinct()


@query("j13_node_titles", "SELECT l_orderkey, l_partkey, max(p_name) AS title, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def j13(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left").groupBy("l_orderkey", "l_partkey").agg(F.max("p_name").alias("title"), F.count("*").alias("n"))


@query("j14_local_graph", f"WITH {EDGES} SELECT src, dst, rel, count(*) AS n FROM edges WHERE src = 77 OR dst = 77 GROUP BY 1, 2, 3")
def j14(spark, d):
    """The relations that touch one node (also G-27)."""
    return edges(spark, d).where("src = 77 OR dst = 77").groupBy("src", "dst", "rel").agg(F.count("*").alias("n"))


@query("j16_verdict_join", f"WITH {EDGES}, e AS (SELECT DISTINCT src || '|' || upper(rel) || '|' || dst AS key, src FROM edges) SELECT key, o_orderstatus AS verdict FROM e JOIN orders ON o_orderkey = src WHERE o_orderstatus <> 'P'")
def j16(spark, d):
    """Verdicts by edge key, the relation in capitals."""
    e = edges(spark, d).select(F.concat_ws("|", "src", F.upper("rel"), "dst").alias("key"), "src").distinct()
    return e.join(table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("src"), F.col("o_orderstatus").alias("verdict")), "src").select("key", "verdict")


@query("j18_consensus_join", f"WITH {EDGES}, a AS (SELECT dst, min(rel) AS rel FROM edges WHERE year % 2 = 0 GROUP BY 1), b AS (SELECT dst, min(rel) AS rel FROM edges WHERE year % 2 = 1 GROUP BY 1) SELECT b.dst, b.rel AS gate, a.rel AS other, coalesce(a.rel = b.rel, false) AS agree FROM b LEFT JOIN a ON a.dst = b.dst")
def j18(spark, d):
    """The second labeller gates; the first may agree."""
    e = edges(spark, d)
    a = e.where("year % 2 = 0").groupBy("dst").agg(F.min("rel").alias("other"))
    return e.where("year % 2 = 1").groupBy("dst").agg(F.min("rel").alias("gate")).join(a, "dst", "left").select("dst", "gate", "other", F.coalesce(F.col("other") == F.col("gate"), F.lit(False)).alias("agree"))


@query("j21_unique_target", f"WITH {EDGES} SELECT src, min(dst) AS dst FROM edges WHERE src <> dst GROUP BY src HAVING count(DISTINCT dst) = 1")
def j21(spark, d):
    """Accepted only where the target is unique (also J-05)."""
    return edges(spark, d).where("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"), F.count_distinct("dst").alias("n")).where("n = 1").select("src", "dst")


@query("j23_identity_state", """WITH x AS (SELECT c_custkey AS id, s_suppkey AS target FROM customer JOIN supplier ON s_suppkey = c_custkey UNION SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > 9500)
  SELECT c_custkey AS id, count(target) AS targets, CASE count(target) WHEN 0 THEN 'unmapped' WHEN 1 THEN 'mapped' ELSE 'ambiguous' END AS state FROM customer LEFT JOIN x ON x.id = c_custkey GROUP BY 1""")
def j23(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), table(spark, d, "supplier")
    by_id = c.join(s.select(F.col("s_suppkey").alias("target")), F.col("id") == F.col("target")).select("id", "target")
    by_nation = c.join(s.where("s_acctbal > 9500").select(F.col("s_suppkey").alias("target"), "s_nationkey"), F.col("s_nationkey") == F.col("c_nationkey")).select("id", "target")
    n = c.join(by_id.union(by_nation).distinct(), "id", "left").groupBy("id").agg(F.count("target").alias("targets"))
    return n.withColumn("state", F.when(F.col("targets") == 0, "unmapped").when(F.col("targets") == 1, "mapped").otherwise("ambiguous"))


@query("j36_evidence_merge", f"WITH {CITES}, {EDGES}, e AS (SELECT src, dst, count(*) AS k FROM edges WHERE src <> dst GROUP BY 1, 2) SELECT coalesce(c.src, e.src) AS src, coalesce(c.dst, e.dst) AS dst, c.src IS NOT NULL AS known, coalesce(k, 0) AS evidence FROM cites c FULL JOIN e ON c.src = e.src AND c.dst = e.dst")
def j36(spark, d):
    """Evidence for known edges, and edges that evidence adds."""
    e = edges(spark, d).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("k"))
    c = cites(spark, d).withColumn("known", F.lit(True))
    return c.join(e, ["src", "dst"], "full_outer").select("src", "dst", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("k", F.lit(0)).alias("evidence"))


@query("a16_groundedness", "WITH x AS (SELECT conv_id, role, length(text) AS n FROM conversations) SELECT role, count(*) AS turns, avg(CASE WHEN n >= 100 THEN 1.0 ELSE 0.0 END) AS rate, count(*)::DOUBLE / count(DISTINCT conv_id) AS per_conversation FROM x GROUP BY role")
def a16(spark, d):
    x = table(spark, d, "conversations")
    return x.groupBy("role").agg(F.count("*").alias("turns"), F.avg(F.when(F.length("text") >= 100, 1.0).otherwise(0.0)).alias("rate"), (F.count("*") / F.count_distinct("conv_id")).alias("per_conversation"))


@query("a18_citation_validity", "WITH c AS (SELECT l_orderkey AS answer, l_partkey * 2 AS cited FROM lineitem) SELECT answer, count(*) AS cited, count(p_partkey) AS valid, count(p_partkey)::DOUBLE / count(*) AS rate FROM c LEFT JOIN part ON p_partkey = cited GROUP BY answer")
def a18(spark, d):
    """Share of cited ids that exist."""
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("answer"), (F.col("l_partkey") * 2).alias("p_partkey"))
    known = table(spark, d, "part").select("p_partkey").withColumn("ok", F.lit(1))
    return c.join(known, "p_partkey", "left").groupBy("answer").agg(F.count("*").alias("cited"), F.count("ok").alias("valid")).withColumn("rate", F.col("valid") / F.col("cited"))


@query("a27_similarity_buckets", f"WITH {EDGES} SELECT CASE WHEN similarity >= 0.5 THEN 'high' WHEN similarity >= 0.2 THEN 'middle' ELSE 'low' END AS bucket, rel, count(*) AS n FROM edges GROUP BY 1, 2")
def a27(spark, d):
    bucket = F.when(F.col("similarity") >= 0.5, "high").when(F.col("similarity") >= 0.2, "middle").otherwise("low")
    return edges(spark, d).groupBy(bucket.alias("bucket"), "rel").agg(F.count("*").alias("n"))


@query("a36_answer_rates", "SELECT event_type, avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) AS abstention, count(*) AS n, CASE WHEN avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END) >= 0.3 THEN 'pass' ELSE 'warn' END AS status FROM events GROUP BY 1")
def a36(spark, d):
    x = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(F.col("value") < 5, 1.0).otherwise(0.0)).alias("abstention"), F.count("*").alias("n"))
    return x.withColumn("status", T.metric_status(F.col("abstention"), 0.3))


@query("k05_clear_edges", f"WITH {EDGES} SELECT rel, count(*) AS n FROM edges WHERE src NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 0) GROUP BY rel")
def k05(spark, d):
    """What stays after a collection's relations are cleared."""
    gone = table(spark, d, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("src"))
    return edges(spark, d).join(gone, "src", "left_anti").groupBy("rel").agg(F.count("*").alias("n"))


@query("k07_tag_untagged", "SELECT coalesce(CASE WHEN p_size > 25 THEN p_type END, 'default') AS collection, count(*) AS n FROM part GROUP BY 1")
def k07(spark, d):
    from quillgraph.operators.tables import tag_untagged

    p = table(spark, d, "part").withColumn("collection", F.when(F.col("p_size") > 25, F.col("p_type")))
    return tag_untagged(p, "default").groupBy("collection").agg(F.count("*").alias("n"))


@query("r09_resume", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM labels)")
def r09(spark, d):
    """What a checkpoint table does not hold yet."""
    done = table(spark, d, "labels").select(F.col("doc_id").alias("event_id"))
    return table(spark, d, "events").select("event_id").join(done, "event_id", "left_anti")


@query("w10_by_year_desc", f"WITH {WORKS} SELECT id, year FROM works ORDER BY year DESC NULLS FIRST, id LIMIT 30")
def w10(spark, d):
    return works(spark, d).select("id", "year").orderBy(F.desc_nulls_first("year"), "id").limit(30)


@query("x06_short_cite", "SELECT o_orderkey, 'Clerk et al. ' || year(o_orderdate)::INT AS cite FROM orders")
def x06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.lit("Ann Clerk"), F.lit("Bo Clerk")).alias("authors"), F.year("o_orderdate").alias("year"))
    return o.select("o_orderkey", I.short_cite(F.col("authors"), F.col("year")).alias("cite"))


@query("x07_safe_year", "SELECT doc_id, TRY_CAST(substr(text, 1, 4) AS INT) AS year FROM documents")
def x07(spark, d):
    return table(spark, d, "documents").select("doc_id", T.safe_year(F.col("text")).alias("year"))


@query("x18_cited_ids", "SELECT p_partkey, ['p:' || p_partkey, 's:' || p_size] AS ids FROM part")
def x18(spark, d):
    answer = F.concat(F.lit("see [p:"), "p_partkey", F.lit("] and [s:"), "p_size", F.lit("], again [p:"), "p_partkey", F.lit("]"))
    return table(spark, d, "part").select("p_partkey", T.cited_ids(answer).alias("ids"))


@query("x24_safe_name", "SELECT doc_id, regexp_replace(substr(text, 1, 40), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM documents")
def x24(spark, d):
    return table(spark, d, "documents").select("doc_id", T.safe_name(F.substring("text", 1, 40)).alias("name"))


@query("d05_scan_from", "SELECT o_orderkey, (o_orderdate::DATE - 7) AS scan_from FROM orders")
def d05(spark, d):
    from quillgraph.streaming.incremental import scan_from

    return table(spark, d, "orders").select("o_orderkey", scan_from(F.col("o_orderdate").cast("date"), F.lit("2024-01-01").cast("date")).alias("scan_from"))

"""Graph, retrieval and statistics queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import stats as S
from quillgraph.functions import text as T
from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R
from quillgraph.plans.base import CITES, EDGES, WORKS, cites, edges, table, works
from quillgraph.plans.registry import query
from quillgraph.plans.relational import KEY, TOKENS

STARTS = "starts AS (SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 400000)"


def starts(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("node"))


def named_cites(spark, d):
    return cites(spark, d).withColumn("rel", F.lit("cites"))


@query("g01_neighbours", f"WITH {EDGES}, {STARTS} SELECT node, neighbour, rel, way, count(*) AS n FROM (SELECT node, dst AS neighbour, rel, 'out' AS way FROM starts JOIN edges ON src = node UNION ALL SELECT node, src, rel, 'in' FROM starts JOIN edges ON dst = node) GROUP BY ALL")
def g01(spark, d):
    return G.neighbours(edges(spark, d), starts(spark, d)).groupBy("node", "neighbour", "rel", "way").agg(F.count("*").alias("n"))


@query("g02_paths", f"""WITH RECURSIVE {CITES}, {STARTS}, p AS (SELECT node AS start, dst AS last, 1 AS hops, [node, dst] AS path FROM starts JOIN cites ON src = node
  UNION ALL SELECT start, dst, hops + 1, list_append(path, dst) FROM p JOIN cites ON src = last WHERE hops < 3) SELECT start, hops, path FROM p""")
def g02(spark, d):
    return G.paths(named_cites(spark, d), starts(spark, d), 3)


@query("g03_point_get", "SELECT o_orderkey AS id, o_orderstatus AS label, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS children FROM orders WHERE o_orderkey IN (7, 77, 777)")
def g03(spark, d):
    n = table(spark, d, "lineitem").where(F.col("l_orderkey").isin(7, 77, 777)).groupBy("l_orderkey").agg(F.count("*").alias("k"))
    return table(spark, d, "orders").where(F.col("o_orderkey").isin(7, 77, 777)).join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), F.coalesce("k", F.lit(0)).alias("children"))


CLOSURE = "c AS (SELECT node AS start, dst AS node FROM starts JOIN cites ON src = node UNION SELECT start, dst FROM c JOIN cites ON src = c.node)"


@query("g04_closure", f"WITH RECURSIVE {CITES}, {STARTS}, {CLOSURE} SELECT start, node FROM c")
def g04(spark, d):
    return G.closure(named_cites(spark, d), starts(spark, d))


@query("g05_grounding", f"WITH RECURSIVE {CITES}, {STARTS}, {CLOSURE} SELECT start, count(*) AS ancestors, count(*) FILTER (node % 3 = 0) AS traced FROM c GROUP BY start")
def g05(spark, d):
    """How many of an origin's ancestors a trace names."""
    return g04(spark, d).groupBy("start").agg(F.count("*").alias("ancestors"), F.count_if(F.col("node") % 3 == 0).alias("traced"))


@query("g06_backward_hops", f"WITH {CITES}, {STARTS}, a AS (SELECT node AS start, dst AS node FROM starts JOIN cites ON src = node) SELECT DISTINCT start, node FROM (SELECT * FROM a UNION ALL SELECT start, dst FROM a JOIN cites ON src = a.node)")
def g06(spark, d):
    return G.closure(named_cites(spark, d), starts(spark, d), rounds=2)


@query("g07_snowball", f"""WITH {CITES}, {STARTS}, r AS (SELECT dst AS node, 'backward' AS way FROM cites WHERE src IN (SELECT node FROM starts) UNION SELECT src, 'forward' FROM cites WHERE dst IN (SELECT node FROM starts))
  SELECT node, min(way) AS way FROM r WHERE node NOT IN (SELECT node FROM starts) GROUP BY node""")
def g07(spark, d):
    """New works one hop away: what the seeds cite and what cites them (also G-08 and each round of G-09)."""
    s, c = starts(spark, d), cites(spark, d)
    back = c.join(s, c["src"] == s["node"], "left_semi").select(F.col("dst").alias("node"), F.lit("backward").alias("way"))
    ahead = c.join(s, c["dst"] == s["node"], "left_semi").select(F.col("src").alias("node"), F.lit("forward").alias("way"))
    return back.unionByName(ahead).join(s, "node", "left_anti").groupBy("node").agg(F.min("way").alias("way"))


@query("g10_greedy_communities")
def g10(spark, d):
    return G.greedy_communities(cites(spark, d))


MEMBERS = "m AS (SELECT o_orderkey AS node, o_custkey % 9 AS community FROM orders)"


@query("g11_modularity", f"""WITH {EDGES}, {MEMBERS}, p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst), b AS (SELECT a.community AS cu, c.community AS cv FROM p JOIN m a ON a.node = u JOIN m c ON c.node = v),
  g AS (SELECT community, count(*) AS degree FROM (SELECT cu AS community FROM b UNION ALL SELECT cv FROM b) GROUP BY 1), t AS (SELECT count(*)::DOUBLE AS m, count(*) FILTER (cu = cv) AS inside FROM b)
  SELECT round(inside / m - (SELECT sum(degree::DOUBLE * degree) FROM g) / (4 * m * m), 9) AS modularity FROM t""")
def g11(spark, d):
    members = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), (F.col("o_custkey") % 9).alias("community"))
    return G.modularity(edges(spark, d), members).select(F.round("modularity", 9).alias("modularity"))


@query("g12_components", f"WITH RECURSIVE {CITES}, b AS (SELECT src, dst FROM cites UNION SELECT dst, src FROM cites), r AS (SELECT src AS node, src AS root FROM b UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.node) SELECT node, min(root) AS component FROM r GROUP BY node")
def g12(spark, d):
    return G.components(cites(spark, d))


@query("g13_ranks", f"WITH RECURSIVE {CITES}, n AS (SELECT src AS node FROM cites UNION SELECT dst FROM cites), r AS (SELECT node, 0 AS depth FROM n UNION SELECT dst, depth + 1 FROM r JOIN cites ON src = node) SELECT node, max(depth) AS depth FROM r GROUP BY node")
def g13(spark, d):
    return G.ranks(cites(spark, d))


@query("g14_relaxed_depth", f"WITH RECURSIVE {CITES}, n AS (SELECT src AS node FROM cites UNION SELECT dst FROM cites), r AS (SELECT node, 0 AS depth FROM n UNION SELECT dst, depth + 1 FROM r JOIN cites ON src = node WHERE depth < 8) SELECT node, max(depth) AS depth FROM r GROUP BY node")
def g14(spark, d):
    return G.relaxed_depth(cites(spark, d))


@query("g16_ancestors", f"WITH RECURSIVE {CITES}, {STARTS}, c AS (SELECT node AS start, src AS node FROM starts JOIN cites ON dst = node UNION SELECT start, src FROM c JOIN cites ON dst = c.node) SELECT start, count(*) AS n FROM c GROUP BY start")
def g16(spark, d):
    back = cites(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.closure(back, starts(spark, d)).groupBy("start").agg(F.count("*").alias("n"))


@query("g17_ring_layout", """WITH r AS (SELECT p_partkey AS id, p_size % 9 AS c, row_number() OVER (PARTITION BY p_size % 9 ORDER BY p_partkey) - 1 AS k FROM part)
  SELECT id, round(cos(2 * 3.141592653589793::DOUBLE * c / 9) * 100 + cos(k * 2.399963229728653::DOUBLE) * sqrt(k + 0.5::DOUBLE) * 4, 5) AS x, round(sin(2 * 3.141592653589793::DOUBLE * c / 9) * 100 + sin(k * 2.399963229728653::DOUBLE) * sqrt(k + 0.5::DOUBLE) * 4, 5) AS y FROM r""")
def g17(spark, d):
    out = G.ring_layout(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), F.col("p_size") % 9, F.col("id"))
    return out.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("g20_keyword_vote", """WITH s AS (SELECT doc_id, [struct_pack(n := (length(text) - length(replace(text, ' the ', ''))) // 5, label := 'english'), struct_pack(n := (length(text) - length(replace(text, ' der ', ''))) // 5, label := 'german'), struct_pack(n := (length(text) - length(replace(text, ' que ', ''))) // 5, label := 'romance')] AS v FROM documents)
  SELECT doc_id, list_sort(v, 'DESC')[1].label AS label, list_sort(v, 'DESC')[1].n AS votes FROM s""")
def g20(spark, d):
    """The label with the most keyword hits; of equals, the later name."""
    votes = [F.struct(T.occurrences(F.col("text"), f" {k} ").alias("n"), F.lit(name).alias("label")) for k, name in (("the", "english"), ("der", "german"), ("que", "romance"))]
    best = F.array_max(F.array(*votes))
    return table(spark, d, "documents").select("doc_id", best["label"].alias("label"), best["n"].alias("votes"))


@query("g23_lints", f"""WITH {EDGES}, {WORKS}, {CITES}, k AS (SELECT doc_id, {KEY.format('substr(text, 1, 60)')} AS t FROM documents),
  f AS (SELECT 'duplicate_paper' AS lint, t AS target, count(*) AS n FROM k WHERE length(t) >= 8 GROUP BY t HAVING count(*) > 1
  UNION ALL SELECT 'intra_paper_edge', src::VARCHAR, count(*) FROM edges WHERE src = dst GROUP BY src
  UNION ALL SELECT 'isolated_paper', id::VARCHAR, 1 FROM works WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)
  UNION ALL SELECT 'precedence_year_conflict', src || '>' || dst, count(*) FROM edges JOIN works a ON a.id = src JOIN works b ON b.id = dst WHERE rel = 'builds_on' AND a.year < b.year GROUP BY src, dst
  UNION ALL SELECT 'low_confidence_edge', src || '>' || dst, count(*) FROM edges WHERE confidence < 0.55 GROUP BY src, dst) SELECT lint, target, n::BIGINT AS n FROM f""")
def g23(spark, d):
    from quillgraph.operators.quality import lints

    titles = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"))
    return lints(titles, works(spark, d), edges(spark, d))


@query("g26_edge_derivation", "SELECT l_orderkey || '::c' || l_linenumber AS src, l_orderkey::VARCHAR AS dst, 'stated_in' AS rel FROM lineitem UNION SELECT l_orderkey || '::c' || l_linenumber, l_orderkey || '::contrib' || (l_partkey % 5), 'supports_contrib' FROM lineitem WHERE l_returnflag = 'A'")
def g26(spark, d):
    """Each claim is stated in its paper, and supports its contribution where it has one."""
    c = table(spark, d, "lineitem").select(F.concat("l_orderkey", F.lit("::c"), "l_linenumber").alias("src"), F.col("l_orderkey").cast("string").alias("paper"), F.when(F.col("l_returnflag") == "A", F.concat("l_orderkey", F.lit("::contrib"), F.col("l_partkey") % 5)).alias("contribution"))
    stated = c.select("src", F.col("paper").alias("dst"), F.lit("stated_in").alias("rel"))
    return stated.unionByName(c.where("contribution IS NOT NULL").select("src", F.col("contribution").alias("dst"), F.lit("supports_contrib").alias("rel"))).distinct()


KNN = """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings e ON {0} WHERE q.vec_id % 50 = 0)
  SELECT query_id, id, round(c, 6) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id)::INT AS rank FROM s) WHERE rank <= {1}"""


def _knn(spark, d, k, unlike=None):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))
    return R.knn(e, "vec_id", "embedding", q, "query_id", "query_vector", k, unlike=unlike).select("query_id", "id", F.round("cosine", 6).alias("cosine"), "rank")


@query("v01_knn", KNN.format("true", 8))
def v01(spark, d):
    return _knn(spark, d, 8)


@query("j09_cross_group_knn", KNN.format("q.label <> e.label", 5))
def j09(spark, d):
    return _knn(spark, d, 5, ("label", "query_label"))


OKAPI = f"""t AS (SELECT {{0}} AS id, unnest({TOKENS.format('text')}) AS term FROM {{1}}), p AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT id, count(*) AS dl FROM t GROUP BY 1), n AS (SELECT (SELECT count(*) FROM {{1}})::DOUBLE AS n, (SELECT count(*) FROM t) AS total),
  i0 AS (SELECT term, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, n GROUP BY term, n.n), m AS (SELECT avg(idf) AS mean FROM i0), i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM i0, m),
  w AS (SELECT id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n.n))) AS weight FROM p JOIN l USING (id) JOIN i USING (term), n)"""


@query("v03_bm25", f"""WITH {OKAPI.format('doc_id', 'documents')}, q AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark), s AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM q JOIN w USING (term) GROUP BY 1, 2)
  SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def v03(spark, d):
    """The five best documents of each benchmark text (also W-01, W-02)."""
    s = R.bm25(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text").withColumn("score", F.round("score", 6))
    return R.top(s.where("score > 0"), "query_id", "score", "id", 5)


@query("j07_lexical_neighbours", f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, text FROM conversations), {OKAPI.format('id', 'c')}, q AS (SELECT id AS query_id, unnest({TOKENS.format('text')}) AS term FROM c WHERE id % 50 = 0),
  s AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM q JOIN w USING (term) WHERE query_id // 1000 <> id // 1000 GROUP BY 1, 2) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 3""")
def j07(spark, d):
    """Neighbours from other conversations, the best three, of the turns whose id is divisible by 50."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    c = table(spark, d, "conversations").select(key.alias("id"), "text", F.floor(key / 1000).alias("conversation"))
    return R.bm25_top(c, "id", "text", "conversation", c.where("id % 50 = 0"), "id", "text", "conversation", 3)


@query("v04_scope_gate")  # its SQL is too slow on whole texts: tested against brute force
def v04(spark, d):
    s = R.gate_scores(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text").withColumn("score", F.round("score", 6))
    return R.top(s, "query_id", "score", "id", 5)


@query("v06_jaccard", f"WITH {EDGES}, p AS (SELECT l_orderkey AS node, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT src, dst, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS jaccard, min(rel) AS rel FROM edges JOIN p a ON a.node = src JOIN p b ON b.node = dst WHERE src <> dst GROUP BY src, dst, a.s, b.s")
def v06(spark, d):
    """Similarity of the two ends of each edge (also V-11's criterion)."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_set("l_suppkey").alias("s"))
    e = edges(spark, d).where("src <> dst").groupBy("src", "dst").agg(F.min("rel").alias("rel"))
    both = e.join(p.select(F.col("node").alias("src"), F.col("s").alias("a")), "src").join(p.select(F.col("node").alias("dst"), F.col("s").alias("b")), "dst")
    return both.select("src", "dst", T.jaccard(F.col("a"), F.col("b")).alias("jaccard"), "rel")


SURVIVAL = """WITH x AS (SELECT c_custkey AS id, 3 + c_custkey % 5 AS found, 40 + c_custkey % 30 AS screened, 200 AS total FROM customer), y AS (SELECT *, least(total, ceil(found / 0.95::DOUBLE)::INT) AS relevant FROM x),
  t AS (SELECT id, exp(lgamma(relevant + 1) - lgamma(k + 1) - lgamma(relevant - k + 1) + lgamma(total - relevant + 1) - lgamma(screened - k + 1) - lgamma(total - relevant - screened + k + 1) - lgamma(total + 1) + lgamma(screened + 1) + lgamma(total - screened + 1)) AS p
    FROM (SELECT *, unnest(range(found, least(relevant, screened) + 1)) AS k FROM y))
  SELECT id, round(sum(p), 8) AS p, sum(p) < 0.05 AS reached FROM t GROUP BY id"""


@query("m02_recall_reached", SURVIVAL)
def m02(spark, d):
    """The survival probability of each customer's search, and whether it may stop."""
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (3 + F.col("c_custkey") % 5).cast("int").alias("found"), (40 + F.col("c_custkey") % 30).cast("int").alias("screened"), F.lit(200).alias("total"))
    state = (F.col("found"), F.col("screened"), F.col("total"))
    return x.select("id", F.round(S.stop_p_value(*state), 8).alias("p"), S.recall_reached(*state).alias("reached"))


@query("m04_arbiter", f"WITH {EDGES} SELECT dst, round(avg(0.4 * confidence + 0.4 * (1 - similarity) + 0.2 * similarity), 9) AS trust, count(*) AS n FROM edges GROUP BY dst")
def m04(spark, d):
    e = edges(spark, d)
    return e.groupBy("dst").agg(F.round(F.avg(S.arbiter_trust(F.col("confidence"), 1 - F.col("similarity"), F.col("similarity"))), 9).alias("trust"), F.count("*").alias("n"))


@query("m06_calibration_error", """WITH b AS (SELECT least(floor(l_discount * 100 / 11.0 * 10), 9)::INT AS bin, count(*) AS n, avg(l_discount * 100 / 11.0) AS mean_score, avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END) AS accuracy FROM lineitem GROUP BY 1)
  SELECT round(sum(n * abs(round(accuracy, 3) - round(mean_score, 3))) / sum(n), 9) AS ece FROM b""")
def m06b(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_discount") * 100 / 11.0).alias("score"), (F.col("l_returnflag") == "A").cast("int").alias("label"))
    return S.calibration_error(S.reliability(x, "score", "label")).select(F.round("ece", 9).alias("ece"))


@query("g19_timeline", "SELECT o_orderkey AS id, o_custkey % 9 AS lane, year(o_orderdate) + (month(o_orderdate) - 1) / 12.0::DOUBLE AS x, row_number() OVER (PARTITION BY o_custkey % 9, year(o_orderdate), month(o_orderdate) ORDER BY o_orderkey)::INT AS slot FROM orders")
def g19(spark, d):
    """A lane for each community, and a slot within each month."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9).alias("lane"), (F.year("o_orderdate") + (F.month("o_orderdate") - 1) / F.lit(12.0)).alias("x"))
    return o.withColumn("slot", F.row_number().over(W.partitionBy("lane", "x").orderBy("id")))

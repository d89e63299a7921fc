"""Matching, repairing and merging of records, over all of the driver's rows; query sets are rows whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import citations as C
from quillgraph.functions import identity as I
from quillgraph.functions import text as T
from quillgraph.operators import matching as M
from quillgraph.plans.base import CITES, EDGES, WORKS, cites, edges, table, works
from quillgraph.plans.citations import REFS, refs
from quillgraph.plans.graphs import KNN, _knn
from quillgraph.plans.registry import query

WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
PART_WORDS = WORDS.format("p_name || ' ' || p_type || ' ' || p_brand || ' size ' || p_size")


def parts(spark, d):
    """id, words, doi, arxiv of each part."""
    words = F.array_distinct(T.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.lit("size"), "p_size")))
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("id"), words.alias("words"), F.when(key % 3 == 1, F.concat(F.lit("10.1000/"), key.cast("string"))).alias("doi"), F.when(key % 3 == 0, F.concat(F.lit("2401."), key.cast("string"))).alias("arxiv"))


PARTS = f"parts AS (SELECT p_partkey AS id, {PART_WORDS} AS words, CASE p_partkey % 3 WHEN 1 THEN '10.1000/' || p_partkey END AS doi, CASE p_partkey % 3 WHEN 0 THEN '2401.' || p_partkey END AS arxiv FROM part)"
COMMON = "len(list_intersect(a.words, b.words))"


@query("j25_gold_match", f"""WITH {PARTS}, a AS (SELECT id, list_concat(words, ['extra']) AS words, CASE WHEN id % 4 <> 0 THEN doi END AS doi, arxiv FROM parts WHERE id % 50 = 0),
  s AS (SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.doi = b.doi OR a.arxiv = b.arxiv THEN 1.0::DOUBLE ELSE {COMMON}::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) END AS score FROM a, parts b)
  SELECT a_id, b_id, score FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS r FROM s WHERE score >= 0.82) WHERE r = 1""")
def j25(spark, d):
    """The best work for each gold record, whose title has one word more and of which some have no identifier."""
    p = parts(spark, d)
    gold = p.where("id % 50 = 0").select("id", F.concat("words", F.array(F.lit("extra"))).alias("words"), F.when(F.col("id") % 4 != 0, F.col("doi")).alias("doi"), "arxiv")
    return M.gold_matches(gold, p)


@query("j29_title_twin", f"WITH {PARTS} SELECT a.id AS a_id, min(b.id) AS b_id FROM parts a, parts b WHERE a.id % 50 = 0 AND len(a.words) >= 4 AND {COMMON}::DOUBLE / greatest(len(a.words), len(b.words)) > 0.85 GROUP BY a.id")
def j29(spark, d):
    p = parts(spark, d)
    return M.title_twins(p.where("id % 50 = 0"), p)


@query("j28_contained_title", f"""WITH {PARTS}, a AS (SELECT id, list_concat(words, ['pdf', 'scan']) AS words, doi FROM parts WHERE id % 50 = 0), x AS (SELECT a.id AS a_id, min(b.id) AS b_id FROM a JOIN parts b ON a.doi = b.doi GROUP BY a.id),
  s AS (SELECT a.id AS a_id, b.id AS b_id, {COMMON}::DOUBLE / least(len(a.words), len(b.words)) AS c FROM a, parts b WHERE a.id NOT IN (SELECT a_id FROM x))
  SELECT * FROM x UNION ALL SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY c DESC, b_id) AS r FROM s WHERE c > 0.7) WHERE r = 1""")
def j28(spark, d):
    p = parts(spark, d)
    return M.contained_titles(p.where("id % 50 = 0").select("id", F.concat("words", F.array(F.lit("pdf"), F.lit("scan"))).alias("words"), "doi"), p)


@query("j27_nearest_neighbour", f"""WITH {PARTS}, s AS (SELECT a.id AS a_id, b.id AS b_id, {COMMON}::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) AS jaccard FROM parts a, parts b WHERE a.id % 50 = 0 AND b.id % 50 <> 0)
  SELECT a_id, b_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY jaccard DESC, b_id) AS r FROM s WHERE jaccard > 0) WHERE r = 1""")
def j27(spark, d):
    """Of each isolated part (its id divisible by 50) the most similar other one."""
    p = parts(spark, d).select("id", "words")
    return M.nearest(p.where("id % 50 = 0"), p.where("id % 50 <> 0"))


@query("j24_backfill_edges", f"WITH {REFS} SELECT DISTINCT id, part AS dst FROM refs WHERE part % 3 < 2")
def j24(spark, d):
    """Citations whose reference states the arXiv id or DOI of a held work."""
    r = refs(spark, d)
    held = r.select(F.col("part").alias("dst"), "title", F.regexp_replace("ident", "^arXiv:", "arxiv:").alias("stated")).distinct().where("dst % 3 < 2")
    return M.stated_works(r.select("id", "raw"), held).select("id", "dst").distinct()


@query("j30_abstract_repair", "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 1 THEN p_name || ' anew' ELSE p_name END AS abstract, p_partkey % 4 = 1 AS changed FROM part")
def j30(spark, d):
    """Abstracts from records with the same base id, where they have another, not empty one."""
    key = F.col("p_partkey")
    p = table(spark, d, "part").select(key.alias("id"), F.concat(F.lit("2401."), key.cast("string"), F.lit("v2")).alias("arxiv"), F.col("p_name").alias("abstract"))
    told = table(spark, d, "part").select(F.concat(F.lit("2401."), key.cast("string")).alias("base"), F.when(key % 4 == 1, F.concat("p_name", F.lit(" anew"))).when(key % 4 == 2, "").when(key % 4 == 3, F.col("p_name")).alias("new"))
    both = p.join(told, I.arxiv(F.col("arxiv")) == F.col("base"), "left")
    changed = F.coalesce((F.col("new") != "") & (F.col("new") != F.col("abstract")), F.lit(False))
    return both.select("id", F.when(changed, F.col("new")).otherwise(F.col("abstract")).alias("abstract"), changed.alias("changed"))


@query("j31_as_of", "SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def j31(spark, d):
    """Each click's user's last purchase up to then."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    clicks, bought = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return M.as_of(clicks, bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("j08_proposed_pairs", f"WITH {CITES}, {EDGES}, p AS (SELECT src AS owner, dst AS other, 0 AS rank FROM cites UNION ALL SELECT src, dst, 1 FROM edges) SELECT owner, other FROM (SELECT *, row_number() OVER (PARTITION BY least(owner, other), greatest(owner, other) ORDER BY owner, rank, other) AS r FROM p WHERE owner <> other) WHERE r = 1")
def j08(spark, d):
    """Pairs that citations or relations propose, each once, with the first owner."""
    one = cites(spark, d).select(F.col("src").alias("owner"), F.col("dst").alias("other"), F.lit(0).alias("rank"))
    return M.first_owner(one.unionByName(edges(spark, d).select(F.col("src").alias("owner"), F.col("dst").alias("other"), F.lit(1).alias("rank"))))


@query("j19_annotation_join", "SELECT d.doc_id, count(l.doc_id) AS n, count(*) FILTER (l.toxic = 1) AS toxic, coalesce(max(l.quality), -1) AS mine FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id")
def j19(spark, d):
    """All documents with what is known of their annotations."""
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.max("quality").alias("mine"))
    x = table(spark, d, "documents").select("doc_id").join(l, "doc_id", "left")
    return x.select("doc_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("mine", F.lit(-1)).alias("mine"))


@query("e04_identity_keys", f"WITH {REFS} SELECT DISTINCT part, unnest(['p' || part, CASE part % 3 WHEN 0 THEN 'arxiv:' || substr(ident, 7) WHEN 1 THEN ident ELSE 'title:' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) END]) AS name FROM refs")
def e04(spark, d):
    """The names by which each cited work would be found again in a queue."""
    r = refs(spark, d).select("part", "title", "ident").distinct()
    p = F.concat(F.lit("p"), F.col("part").cast("string"))
    return r.select("part", F.explode(M.identity_keys(p, I.aliases(F.col("ident")), I.key(F.col("title"), p))).alias("name"))


@query("e05_title_duplicates", """WITH k AS (SELECT doc_id, n_chars, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
  SELECT doc_id, canonical FROM (SELECT doc_id, count(*) OVER (PARTITION BY t) AS n, first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS canonical FROM k WHERE length(t) >= 8) WHERE n > 1""")
def e05(spark, d):
    """Records with one title key (here of whole texts), and the one that stands for them: the largest, then the first."""
    k = table(spark, d, "documents").select("doc_id", "n_chars", I.title_key(F.coalesce("text", F.lit(""))).alias("t")).where(F.length("t") >= I.LEAST_TITLE).select("doc_id", "n_chars", F.sha1("t").alias("t"))
    groups = k.groupBy("t").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("n_chars")).alias("c"), "doc_id")).alias("best")).where("n > 1")
    return k.join(groups, "t").select("doc_id", F.col("best.doc_id").alias("canonical"))


@query("w04_structural_origin", f"WITH {CITES}, {WORKS}, n AS (SELECT id, collection, year, coalesce(k, 0) AS k FROM works LEFT JOIN (SELECT dst, count(*) AS k FROM cites GROUP BY 1) ON dst = id) SELECT collection, id FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY k DESC, coalesce(year, 9999), id) AS r FROM n) WHERE r = 1")
def w04(spark, d):
    """The first of the foundational order within each collection."""
    n = cites(spark, d).groupBy("dst").agg(F.count("*").alias("k"))
    w = works(spark, d).join(n, F.col("id") == F.col("dst"), "left")
    return w.groupBy("collection").agg(F.min(F.struct((-F.coalesce("k", F.lit(0))).alias("k"), F.coalesce("year", F.lit(9999)).alias("y"), "id")).alias("first")).select("collection", "first.id")


@query("w06_forward_anchors", f"WITH {CITES} SELECT dst AS id, count(*) AS n FROM cites WHERE dst % 2 = 0 GROUP BY 1 ORDER BY n DESC, id LIMIT 25")
def w06(spark, d):
    """The 25 most cited works of one source (even ids)."""
    return cites(spark, d).where("dst % 2 = 0").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(25)


@query("w11_row_cap", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def w11(spark, d):
    """A tool's answer: at most 50 rows."""
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50).select("p_partkey", "p_name")


@query("w14_label_assignment")  # greedy: tested against a plain loop
def w14(spark, d):
    """Labels (market segments) to communities (nations), greedily by how many customers they share."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("ci"), (F.conv(F.substring(F.md5("c_mktsegment"), 1, 4), 16, 10).cast("long")).alias("li")).agg(F.count("*").alias("score"))
    return M.greedy_assignment(c)


FRAMES = "sum(o_totalprice::DECIMAL(38, 2)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::DOUBLE AS three, count(*) OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS two_years"


@query("w18_frames", f"SELECT o_orderkey, {FRAMES}, lead(o_orderkey) OVER w AS next, lag(o_orderkey) OVER w AS last, nth_value(o_orderkey, 2) OVER w AS second, ntile(3) OVER w AS third FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w18(spark, d):
    """Row and range frames, neighbours, positions and tiles within each customer's orders."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    years = W.partitionBy("o_custkey").orderBy("year").rangeBetween(-1, 0)
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return o.select(
        "o_orderkey", F.sum(F.col("o_totalprice").cast("decimal(38,2)")).over(w.rowsBetween(-2, 0)).cast("double").alias("three"), F.count("*").over(years).alias("two_years"), F.lead("o_orderkey").over(w).alias("next"),
        F.lag("o_orderkey").over(w).alias("last"), F.nth_value("o_orderkey", 2).over(w).alias("second"), F.ntile(3).over(w).alias("third"),
    )


@query("u01_channel_union", f"WITH {CITES}, {EDGES} SELECT node, min(channel)::INT AS channel FROM (SELECT dst AS node, 0 AS channel FROM cites UNION ALL SELECT dst, 1 FROM edges UNION ALL SELECT o_orderkey, 2 FROM orders) GROUP BY node")
def u01(spark, d):
    """Works that citations, relations or the list name, with the first channel that does."""
    return M.first_of([cites(spark, d).select(F.col("dst").alias("node")), edges(spark, d).select(F.col("dst").alias("node")), table(spark, d, "orders").select(F.col("o_orderkey").alias("node"))], "node")


@query("u05_ordered_distinct", "WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark) SELECT item_id, array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: list_position(ws, ws[i]) = i), lambda i: ws[i]), ' ') AS words FROM t")
def u05(spark, d):
    """Words in the order in which they first come."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_distinct(T.tokens(F.col("text"))), " ").alias("words"))


@query("u06_overlap", f"WITH {EDGES}, s AS (SELECT l_orderkey AS node, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) SELECT DISTINCT src, dst, list_has_any(a.s, b.s) AS common FROM edges JOIN s a ON a.node = src JOIN s b ON b.node = dst")
def u06(spark, d):
    """Whether two linked works have a supplier in common."""
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.collect_set("l_suppkey").alias("s"))
    e = edges(spark, d).select("src", "dst").distinct()
    both = e.join(s.select(F.col("node").alias("src"), F.col("s").alias("a")), "src").join(s.select(F.col("node").alias("dst"), F.col("s").alias("b")), "dst")
    return both.select("src", "dst", F.arrays_overlap("a", "b").alias("common"))


@query("x05_work_url", """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'http://x/' || p_partkey WHEN 1 THEN 'https://doi.org/10.1/' || p_partkey WHEN 2 THEN 'https://dx.org/' || p_partkey WHEN 3 THEN 'https://arxiv.org/abs/' || p_partkey
  ELSE CASE WHEN p_partkey % 2 = 0 THEN 'https://openalex.org/W' || p_partkey ELSE '' END END AS url FROM part""")
def x05(spark, d):
    key = F.col("p_partkey")
    text = key.cast("string")
    url, doi = F.when(key % 5 == 0, F.concat(F.lit("http://x/"), text)), F.when(key % 5 == 1, F.concat(F.lit("10.1/"), text)).when(key % 5 == 2, F.concat(F.lit("https://dx.org/"), text)).otherwise("")
    ident = F.when(key % 5 == 3, F.concat(F.lit("arxiv:"), text)).when(key % 2 == 0, F.concat(F.lit("openalex:W"), text)).otherwise(text)
    return table(spark, d, "part").select(key.alias("id"), M.work_url(ident, url, doi).alias("url"))


@query("g28_display_summary", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type || ' → ' || p_brand || ' (for: ' || p_name || ')' END AS shown FROM part")
def g28(spark, d):
    """What is shown of a contribution."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), M.summary(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, ""), F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("shown"))


@query("d02_earliest_variant", "SELECT o_custkey AS work, min(strftime(o_orderdate, '%Y-%m-%d')) AS date FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def d02(spark, d):
    """The earliest real date over a work's variants; dates known to the year only don't count."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("work"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderkey") % 3 == 0, "year").when(F.col("o_orderkey") % 3 == 1, "month").otherwise("day").alias("precision"))
    return o.where(F.col("precision").isin("day", "month") & (F.col("date") != "")).groupBy("work").agg(F.min("date").alias("date"))


@query("f09_read_only", r"""SELECT conv_id, turn, count(*) AS n, bool_and(trim(coalesce(text, '')) <> '' AND NOT regexp_matches(regexp_replace(coalesce(text, ''), '''[^'']*''|"[^"]*"', '', 'g'), '\b(CREATE|MERGE|DELETE|SET|REMOVE|DROP|DETACH|LOAD|CALL|FOREACH|USING|GRANT|REVOKE|DENY|START|ALTER|RENAME)\b', 'i')) AS allowed FROM conversations GROUP BY 1, 2""")
def f09(spark, d):
    """Which turns would pass as queries that only read."""
    return table(spark, d, "conversations").select("conv_id", "turn", M.is_read_only(F.col("text")).alias("ok")).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.every("ok").alias("allowed"))


@query("f10_scrubbed", "SELECT vec_id, label, vec_id % 7 AS seven FROM embeddings")
def f10(spark, d):
    """Rows without embeddings, however deep they lie."""
    e = table(spark, d, "embeddings").select("vec_id", F.struct("label", "embedding", F.array(F.struct((F.col("vec_id") % 7).alias("seven"), "embedding")).alias("inner")).alias("node"), "embedding")
    return M.scrubbed(e).select("vec_id", "node.label", F.col("node.inner")[0]["seven"].alias("seven"))


@query("g21_bridges", f"WITH {EDGES}, c AS (SELECT src AS paper, count(DISTINCT rel) AS spread FROM edges GROUP BY 1) SELECT spread, count(*) AS papers, count(*)::DOUBLE / (SELECT count(*) FROM c) AS share FROM c GROUP BY spread")
def g21(spark, d):
    """How many kinds of relation works spread over, and their share."""
    c = edges(spark, d).groupBy("src").agg(F.count_distinct("rel").alias("spread")).groupBy("spread").agg(F.count("*").alias("papers"))
    whole = c.agg(F.sum("papers").alias("whole"))
    return c.crossJoin(whole).select("spread", "papers", (F.col("papers") / F.col("whole")).alias("share"))  # one row


@query("a06_verdict_lists", "SELECT l_partkey AS target, array_to_string(list_sort(list(l_returnflag)), '') AS verdicts FROM lineitem GROUP BY 1")
def a06(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("target")).agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), "").alias("verdicts"))


@query("a34_build_stats", """SELECT count(*) AS screened, count(*) FILTER (text IS NULL OR trim(text) = '') AS no_text, count(*) FILTER (lang <> 'en') AS other_language, count(*) FILTER (n_chars < 200) AS short,
  count(*) FILTER (text IS NOT NULL AND trim(text) <> '' AND lang = 'en' AND n_chars >= 200) AS included FROM documents""")
def a34(spark, d):
    """Exclusions by reason, and what is left, in one scan."""
    x = table(spark, d, "documents")
    text, lang, size = F.coalesce(F.trim("text") != "", F.lit(False)), F.col("lang"), F.col("n_chars")
    return x.agg(F.count("*").alias("screened"), F.count_if(~text).alias("no_text"), F.count_if(lang != "en").alias("other_language"), F.count_if(size < 200).alias("short"), F.count_if(text & (lang == "en") & (size >= 200)).alias("included"))


@query("t13_verdict_label", "SELECT src, CASE WHEN s + c = 0 THEN 'NOINFO' WHEN c > s THEN 'CONTRADICT' WHEN s > c OR src % 2 = 0 THEN 'SUPPORT' ELSE 'NOINFO' END AS label FROM (WITH " + EDGES + " SELECT src, count(*) FILTER (rel = 'supports') AS s, count(*) FILTER (rel = 'contradicts') AS c FROM edges GROUP BY src)")
def t13(spark, d):
    e = edges(spark, d).groupBy("src").agg(F.count_if(F.col("rel") == "supports").alias("s"), F.count_if(F.col("rel") == "contradicts").alias("c"))
    return e.select("src", M.claim_label(F.when(F.col("src") % 2 == 0, "established").otherwise("contested"), F.col("s"), F.col("c")).alias("label"))


@query("k06_wipe", "SELECT doc_id FROM labels")
def k06(spark, d):
    """Everything goes but annotations."""
    kept = {"labels": table(spark, d, "labels"), "documents": table(spark, d, "documents").limit(0)}
    return kept["labels"].select("doc_id").unionByName(kept["documents"].select("doc_id"))


@query("k08_collection_upsert", "SELECT c_nationkey::BIGINT AS id, max(c_custkey) AS title, min(c_custkey) AS created_at FROM customer GROUP BY 1")
def k08(spark, d):
    """Collections written a second time keep the day on which they were made."""
    from quillgraph.operators.tables import upsert

    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id"))
    return upsert(c.agg(F.min("c_custkey").alias("title"), F.min("c_custkey").alias("created_at")), c.agg(F.max("c_custkey").alias("title"), F.max("c_custkey").alias("created_at")), ["id"], keep=["created_at"])


@query("r04_approve", "SELECT c_custkey AS pos, 'v7' AS version FROM customer WHERE c_custkey NOT IN (1, 4, 9)")
def r04(spark, d):
    """Waiting records but for skipped places, stamped with the version."""
    waiting = table(spark, d, "customer").select(F.col("c_custkey").alias("pos"))
    return M.approve(waiting, (1, 4, 9), "v7", "2024-01-01")[0].select("pos", "version")


@query("v02_merged_retrieval", f"WITH k AS ({KNN.format('true', 8)}) SELECT asked, id, cosine FROM (SELECT query_id // 150 AS asked, id, cosine, row_number() OVER (PARTITION BY query_id // 150, id ORDER BY query_id, rank) AS r FROM k) WHERE r = 1")
def v02(spark, d):
    """Three queries are one question: their neighbours, each once, as first seen."""
    k = _knn(spark, d, 8).withColumn("asked", F.floor(F.col("query_id") / 150))
    return k.groupBy("asked", "id").agg(F.min(F.struct("query_id", "rank", "cosine")).alias("first")).select("asked", "id", "first.cosine")


@query("v12_hashed_embedding", """WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark), c AS (SELECT item_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 64 AS place, count(*) AS n FROM t GROUP BY 1, 2)
  SELECT item_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS weight FROM c""")
def v12(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text")).alias("words"))
    return M.hashed_embedding(rows, "item_id", "words", 64).withColumn("weight", F.round("weight", 9))

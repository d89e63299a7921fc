"""Readers' answers, claims added later, the ledger of references, incoming links, quotes, lineages: over all of the driver's rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import alignment as A
from quillgraph.functions import markup
from quillgraph.operators import graph as G
from quillgraph.operators import matching as M
from quillgraph.operators import reading as R
from quillgraph.operators import resolve as RS
from quillgraph.operators import tables as TB
from quillgraph.operators.labeller import restating
from quillgraph.plans.base import CITES, cites, table
from quillgraph.plans.citations import REFS, refs
from quillgraph.plans.matching import PARTS, parts
from quillgraph.plans.registry import query

ITEMS = """items AS (SELECT l_orderkey AS p, l_partkey AS part, l_suppkey AS supp, row_number() OVER w AS n, count(*) OVER (PARTITION BY l_orderkey) AS k FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate))"""
CLAIM = "p || '::c' || lpad((n - 1)::VARCHAR, 2, '0')"


def items(spark, d):
    """p, part, supp, n of each line item: n is its place within the order."""
    w = W.partitionBy("p").orderBy("l_linenumber", "part", "supp", "l_extendedprice", "l_shipdate")
    return table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "p", "l_partkey": "part", "l_suppkey": "supp"}).select("p", "part", "supp", F.row_number().over(w).alias("n"))


def readings(spark, d):
    """What a reader might return of each order: three contributions at most, a claim and a relation for each item, some of them out of bounds."""
    part, n = F.col("part").cast("string"), F.col("n")
    claim = F.struct(F.concat(F.lit(" claim "), part).alias("text"), F.when(n == 1, "formal").alias("claim_type"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("double").alias("confidence"), (n - 2).alias("contribution"))
    contribution = F.when(n <= 3, F.struct(F.concat(F.lit("made "), part).alias("statement"), F.when(n == 1, "method").otherwise("odd").alias("kind"), F.lit("").alias("quote"), F.lit(0.9).alias("confidence")))
    edge = F.struct((n - 1).alias("src"), (F.col("supp") % 8).cast("int").alias("dst"), F.lit(None).cast("string").alias("relation"), F.lit("").alias("evidence"))
    by_place = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c.alias("x")))), lambda s: s["x"])
    return items(spark, d).groupBy(F.col("p").alias("paper_id")).agg(F.lit("abstract").alias("location"), F.filter(by_place(contribution), lambda c: c.isNotNull()).alias("contributions"), by_place(claim).alias("claims"), by_place(edge).alias("local_edges"))


@query("t14_reader_claims", f"""WITH {ITEMS} SELECT {CLAIM} AS id, p AS paper_id, 'claim ' || part AS text, CASE WHEN n = 1 THEN 'formal' ELSE 'empirical' END AS claim_type, 0.5::DOUBLE AS confidence,
  CASE WHEN n - 2 BETWEEN 0 AND least(k, 3) - 1 THEN p || '::contrib' || (n - 2) END AS contribution_id FROM items""")
def t14(spark, d):
    """Claims of all readings, each with the contribution that its place names."""
    return R.claims(readings(spark, d), R.made_here()).select("id", "paper_id", "text", "claim_type", "confidence", "contribution_id")


@query("t14_reader_contributions", f"""WITH {ITEMS} SELECT p || '::contrib' || (n - 1) AS id, 'made ' || part AS statement, CASE WHEN n = 1 THEN 'method' ELSE 'other' END AS kind,
  CASE WHEN n < k THEN p || '::c' || lpad(n::VARCHAR, 2, '0') ELSE '' END AS claims FROM items WHERE n <= 3""")
def t14_contributions(spark, d):
    """Contributions with the claims that name them; kinds outside the list are other."""
    return R.contributions(readings(spark, d), ["method"]).select("id", "statement", "kind", F.array_join("claim_ids", ",").alias("claims"))


@query("t14_reader_edges", f"WITH {ITEMS} SELECT {CLAIM} AS src, p || '::c' || lpad((supp % 8)::VARCHAR, 2, '0') AS dst, 'supports' AS relation FROM items WHERE supp % 8 < k AND supp % 8 <> n - 1")
def t14_edges(spark, d):
    """Relations between claims of one reading: those out of bounds and loops go."""
    return R.local_edges(readings(spark, d)).select("src", "dst", "relation")


@query("j33_claim_backfill", f"""WITH {ITEMS} SELECT {CLAIM} AS id, 'On made ' || part AS text, p || '::' || lpad(n::VARCHAR, 2, '0') AS contribution_id, o_orderpriority AS location, CASE WHEN n < k THEN p || '::c' || lpad(n::VARCHAR, 2, '0') END AS next
  FROM items JOIN orders ON o_orderkey = p""")
def j33(spark, d):
    """Claims for all orders by their contributions (items), and the claim that each supports."""
    held = items(spark, d).select(F.concat(F.col("p").cast("string"), F.lit("::"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("id"), F.col("p").alias("paper_id"), F.concat(F.lit("made "), F.col("part").cast("string")).alias("statement"), F.lit("method").alias("kind"))
    papers = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("location"))
    claims, links = R.backfill(papers, held, restating)
    return claims.join(links.select(F.col("src").alias("id"), F.col("dst").alias("next")), "id", "left").select("id", "text", "contribution_id", "location", "next")


@query("f02_non_primary", f"""SELECT * FROM (SELECT doc_id, nullif(concat_ws('; ', CASE WHEN t <> '' THEN 'title:''' || t || '''' END, CASE WHEN x <> '' THEN 'framing:''' || x || '''' END), '') AS signals FROM
  (SELECT doc_id, regexp_extract(title, '{R.NON_PRIMARY_TITLE}', 0) AS t, regexp_extract(coalesce(text, ''), '{R.NON_PRIMARY_TEXT}', 0) AS x FROM (SELECT doc_id,
    CASE doc_id % 5 WHEN 0 THEN 'A Survey of ' || source WHEN 1 THEN 'Resurvey of things' WHEN 2 THEN 'Peer review: the case for ' || lang ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'Here We argue. ' ELSE '' END || text AS text FROM documents))) WHERE signals IS NOT NULL""")
def f02(spark, d):
    """Documents, with a title by their id and a framing in one of three, that call themselves survey, position and so on."""
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    title = F.when(i % 5 == 0, F.concat(F.lit("A Survey of "), "source")).when(i % 5 == 1, "Resurvey of things").when(i % 5 == 2, F.concat(F.lit("Peer review: the case for "), "lang")).otherwise("")
    text = F.concat(F.when(i % 3 == 0, "Here We argue. ").otherwise(""), "text")
    return docs.select("doc_id", R.non_primary(title, text).alias("signals")).where("signals IS NOT NULL")


HELD_TITLE = "'Study by ' || o_orderpriority || ' on ' || strftime(o_orderdate, '%Y-%m-%d')"


@query("j05_incoming", f"""WITH {CITES}, o AS (SELECT o_orderkey AS id, {HELD_TITLE} AS title FROM orders),
  m AS (SELECT c.src, c.dst, p.id FROM cites c JOIN o s ON s.id = c.src JOIN o p ON p.title = s.title WHERE (c.src % 3 = 0 OR (c.src % 3 = 2 AND p.id % 2 = 1)) AND p.id <> c.dst
    UNION ALL SELECT src, dst, src FROM cites WHERE src % 3 = 1 AND src % 2 = 0),
  u AS (SELECT dst, min(id) AS src FROM m GROUP BY m.src, m.dst HAVING count(*) = 1)
  SELECT DISTINCT u.src, u.dst FROM u WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE c.src = u.src AND c.dst = u.dst AND c.src % 4 = 0)""")
def j05(spark, d):
    """Each citing order comes back from elsewhere: by its title only, by its DOI only, or under its title with a foreign DOI. What is unique makes a link."""
    orders = table(spark, d, "orders")
    title = F.concat(F.lit("Study by "), "o_orderpriority", F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    empty = {"authors": F.lit(None).cast("array<string>"), "year": F.lit(None).cast("int"), "url": F.lit(None).cast("string")}
    key = F.col("o_orderkey").cast("string")
    held = orders.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("held:"), key).alias("id"), title.alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10.1000/order."), key)).alias("doi")).withColumns(empty)
    src = F.col("src")
    foreign = F.concat(F.when(src % 3 == 1, "10.1000/order.").otherwise("10.1000/other."), src.cast("string"))
    back = cites(spark, d, "o_orderpriority", "o_orderdate").select(
        F.xxhash64("src", "dst").alias("pos"), F.concat(F.lit("back:"), src.cast("string")).alias("id"), F.when(src % 3 == 1, F.concat(F.lit("Preprint number "), src.cast("string"))).otherwise(title).alias("title"),
        F.when(src % 3 != 0, foreign).alias("doi"), F.col("dst").alias("target"),
    ).withColumns(empty)
    return RS.incoming(held, back, cites(spark, d).where("src % 4 = 0"))


@query("t11_ledger", f"""WITH {REFS}, r AS (SELECT *, part % 3 < 2 AS stated, part % 5 <> 0 AS listed, part % 7 <> 0 AS titled FROM refs WHERE id % 4 <> 3)
  SELECT id || '::ref' || lpad(n::VARCHAR, 4, '0') AS reference_id, CASE WHEN NOT stated AND NOT titled THEN 'unresolved' WHEN (NOT stated OR listed) AND part = id THEN 'non_bibliographic' WHEN (NOT stated OR listed) THEN 'resolved_in_corpus' ELSE 'resolved_external' END AS state,
    CASE WHEN stated THEN 'stated_id' WHEN titled THEN 'exact_normalized_title' END AS method, CASE WHEN stated AND listed OR NOT stated AND titled THEN part END AS target FROM r
  UNION ALL SELECT o_orderkey || '::retrieval', 'retrieval_unavailable', NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT id FROM r)""")
def t11(spark, d):
    """The references of all orders against a corpus that lacks some ids and some titles, resumed from a ledger of one order in two."""
    entries = refs(spark, d).where("id % 4 <> 3").select(F.col("id").alias("citing"), F.col("n").alias("pos"), "raw", "title", "part", "ident")
    papers = G.checkpointed(entries.select("part", "title", "ident").distinct())
    titles = papers.where("part % 7 <> 0").select(F.col("part").alias("paper_id"), "title")
    ids = papers.where("part % 5 <> 0 AND ident <> 'In press'").select(F.regexp_replace("ident", "^arXiv:", "arxiv:").alias("alias"), F.col("part").alias("paper_id"))
    works = table(spark, d, "orders").select(F.col("o_orderkey").alias("citing"))
    even = F.col("citing") % 2 == 0
    done = G.checkpointed(R.ledger(works.where(even), entries.where(even), titles, ids))
    return R.ledger(works, entries, titles, ids, done).select("reference_id", "state", "method", "target")


SIX_WORDS = "[a-zA-Z]+( [a-zA-Z]+){5}"


@query("v09_quote_alignment", f"""WITH q AS (SELECT doc_id, text, regexp_extract(text, '{SIX_WORDS}', 0) AS q FROM documents), p AS (SELECT *, strpos(lower(text), lower(q)) - 1 AS s FROM q WHERE q <> '')
  SELECT doc_id, substr(text, s + 1, length(q)) AS quote_verbatim, s::BIGINT AS quote_start, (s + length(q))::BIGINT AS quote_end, 1.0::DOUBLE AS grounding FROM p UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL FROM q WHERE coalesce(q, '') = ''""")
def v09(spark, d):
    """The first six plain words of each text, in capitals, found again in it."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.upper(F.regexp_extract("text", SIX_WORDS, 0)).alias("quote"))
    return A.align_quotes(docs, "doc_id", "quote", "text")


@query("v09_paraphrased_quotes")
def v09_paraphrased(spark, d):
    """Benchmark passages, every seventh letter lost, found again in themselves: grounding tells how much is left."""
    items = table(spark, d, "benchmark").select("item_id", "text", F.regexp_replace("text", "(?s)(.{6}).", "$1").alias("quote"))
    return A.align_quotes(items, "item_id", "quote", "text")


@query("v10_similar_titles")
def v10(spark, d):
    """Parts whose names are nearly those of the parts with an id divisible by 50, five at most of each: a list for people to look at."""
    part = table(spark, d, "part")
    asked = part.where("p_partkey % 50 = 0").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("raw"))
    return A.similar_titles(asked, part.select(F.col("p_partkey").alias("paper_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title")))


@query("g15_lineage_order", """WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
  e AS (SELECT DISTINCT a.id AS src, b.id AS dst, a.c FROM o a JOIN o b ON a.c = b.c AND (a.n = b.n // 2 OR a.n = b.n // 3) WHERE b.n <> 3),
  v AS (SELECT src AS id, c FROM e UNION SELECT dst, c FROM e),
  p(id, path) AS (SELECT id, [id] FROM v WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.id),
  b AS (SELECT id, min(path) AS path FROM p GROUP BY id)
  SELECT id AS node, min(id) OVER (PARTITION BY c) AS family, (row_number() OVER (PARTITION BY c ORDER BY path) - 1)::INT AS place FROM b JOIN v USING (id)""")
def g15(spark, d):
    """Each customer's orders as a family in which order n comes from orders n / 2 and n / 3."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("n"))
    b = o.where("n <> 3").select("c", F.col("id").alias("dst"), F.explode(F.array(F.expr("n div 2"), F.expr("n div 3"))).alias("n")).distinct()
    return G.lineage_order(o.withColumnRenamed("id", "src").join(b, ["c", "n"]).select("src", "dst"))


@query("x11_markdown")
def x11(spark, d):
    """All pages as Markdown."""
    return markup.markdown(table(spark, d, "pages"), "page_id", "html")


@query("s29_gold_anchors", f"""WITH {PARTS}, g AS (SELECT id, list_concat(words, ['extra']) AS words, CASE WHEN id % 4 = 0 THEN 'x' || doi ELSE doi END AS doi, arxiv FROM parts WHERE id % 50 = 0),
  t AS (SELECT g.id AS gold_id, p.id AS work_id, len(list_intersect(g.words, p.words))::DOUBLE / len(list_distinct(list_concat(g.words, p.words))) AS score FROM g, parts p WHERE g.arxiv IS NULL AND (g.doi IS NULL OR g.id % 4 = 0))
  SELECT g.id AS gold_id, p.id AS work_id, CASE WHEN g.arxiv IS NULL THEN 'doi' ELSE 'arxiv' END AS "by" FROM g JOIN parts p ON g.arxiv = p.arxiv OR (g.arxiv IS NULL AND g.doi = p.doi)
  UNION ALL SELECT gold_id, work_id, 'title' FROM (SELECT *, row_number() OVER (PARTITION BY gold_id ORDER BY score DESC, work_id) AS r FROM t WHERE score >= 0.6) WHERE r = 1""")
def s29(spark, d):
    """Gold records (ids divisible by 50, with a word more, some with foreign DOIs) resolved by arXiv id, DOI or title."""
    i = F.col("id")
    gold = parts(spark, d).where(i % 50 == 0).select("id", F.concat("words", F.array(F.lit("extra"))).alias("words"), F.when(i % 4 == 0, F.concat(F.lit("x"), "doi")).otherwise(F.col("doi")).alias("doi"), "arxiv")
    return M.gold_anchors(gold, parts(spark, d))


@query("r06_proposals", """WITH f AS (SELECT p_partkey AS paper_id, 'batch-2024-01-02' AS batch, p_partkey % 2 AS half FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0)
  SELECT paper_id, batch, 'proposed' AS status, (row_number() OVER (ORDER BY half, paper_id))::INT AS place FROM f""")
def r06(spark, d):
    """Parts found by two scans of one day, but for those known by an id or a title."""
    key = F.col("p_partkey")
    part = table(spark, d, "part")
    found = part.select(key.alias("paper_id"), F.array(F.concat(F.lit("id:"), key.cast("string")), F.concat(F.lit("title:"), key.cast("string"))).alias("keys"))
    known = part.where("p_partkey % 3 = 0 OR p_partkey % 7 = 0").select(F.concat(F.when(key % 3 == 0, "id:").otherwise("title:"), key.cast("string")).alias("key"))
    fresh = TB.proposed(found, known, "2024-01-02")
    empty = fresh.where("false").withColumn("place", F.lit(0))
    first = TB.merged_batch(empty, fresh.where("paper_id % 2 = 0"))
    return TB.merged_batch(first, fresh.where("paper_id % 2 = 1"))


@query("k10_event_ledger", """SELECT user_id AS run_id, event_id AS source_event, (row_number() OVER w)::BIGINT AS "order", user_id || ':e' || lpad((row_number() OVER w)::VARCHAR, 6, '0') AS event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id % 2, ts, event_id)""")
def k10(spark, d):
    """Users' events as runs: half of them are in the ledger, the rest goes behind."""
    events = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("source_event"))
    held = TB.event_rows(events.where("source_event % 2 = 0"), "ts")
    return held.unionByName(TB.event_rows(events.where("source_event % 2 = 1"), "ts", held)).select("run_id", "source_event", "order", "event_id")


@query("g25_staged_view", f"""WITH {ITEMS}, c AS (SELECT p || '-' || lpad(n::VARCHAR, 2, '0') AS id, p, n, k, 'item of part ' || part || ' made by the supplier ' || supp AS s FROM items)
  SELECT 1 AS stage, p::VARCHAR AS id, coalesce(min(o_orderdate::DATE::VARCHAR), p::VARCHAR) AS label, NULL AS src, NULL AS dst FROM c LEFT JOIN orders ON o_orderkey = p AND p % 9 <> 0 GROUP BY p
  UNION ALL SELECT 2, id, CASE WHEN length(s) <= 38 THEN s ELSE rtrim(substr(s, 1, 37)) || '…' END, NULL, NULL FROM c
  UNION ALL SELECT 2, NULL, 'stated_in', id, p::VARCHAR FROM c
  UNION ALL SELECT 3, NULL, CASE WHEN n % 2 = 1 THEN 'refines' ELSE 'supports' END, id, p || '-' || lpad((n + 1)::VARCHAR, 2, '0') FROM c WHERE n < k""")
def g25(spark, d):
    """Orders, their items and relations between neighbours, by stage; some orders are not held."""
    name = lambda n: F.concat(F.col("p").cast("string"), F.lit("-"), F.lpad(n.cast("string"), 2, "0"))
    rows = items(spark, d).withColumn("next", F.lead("n").over(W.partitionBy("p").orderBy("n")))
    statement = F.concat(F.lit("item of part "), F.col("part").cast("string"), F.lit(" made by the supplier "), F.col("supp").cast("string"))
    held = table(spark, d, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("title"))
    links = rows.where("next IS NOT NULL").select(name(F.col("n")).alias("src"), name(F.col("next")).alias("dst"), F.when(F.col("n") % 2 == 1, "refines").otherwise("supports").alias("relation"))
    return TB.staged(held, rows.select(name(F.col("n")).alias("id"), F.col("p").alias("paper_id"), statement.alias("statement")), links)

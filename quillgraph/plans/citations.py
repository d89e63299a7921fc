"""Citation texts: full texts and LaTeX sources written from the driver's tables, and read again.

An order is a work whose text cites its line items' parts. One order of four has no text, one lists its references without numbers,
the others with. The SQL knows from the tables what the parsers must find.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import bibliography as B
from quillgraph.functions import citations as C
from quillgraph.functions import identity as I
from quillgraph.plans.base import table
from quillgraph.plans.registry import query

TITLE = "'Study of ' || p_name || ' ' || p_type || ' number ' || lpad(p_partkey::VARCHAR, 7, '0')"
IDENT = "CASE p_partkey % 3 WHEN 0 THEN 'arXiv:2401.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN 1 THEN 'doi:10.1000/part.' || lpad(p_partkey::VARCHAR, 7, '0') ELSE 'In press' END"
REFS = f"""refs AS (SELECT id, part, n, count(*) OVER (PARTITION BY id) AS k, title, ident, 'Author A. ' || title || '. 1995. ' || ident AS raw FROM
  (SELECT l_orderkey AS id, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
  JOIN (SELECT p_partkey, {TITLE} AS title, {IDENT} AS ident FROM part) ON p_partkey = part)"""


def refs(spark, d):
    """id, part, n, title, ident, raw: the references of each order, by part."""
    cited = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part")).distinct().withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("part")))
    key = F.col("p_partkey")
    ident = F.when(key % 3 == 0, F.concat(F.lit("arXiv:2401."), F.lpad((key % 100000).cast("string"), 5, "0"))).when(key % 3 == 1, F.concat(F.lit("doi:10.1000/part."), F.lpad(key.cast("string"), 7, "0"))).otherwise("In press")
    part = table(spark, d, "part").select(key.alias("part"), F.concat(F.lit("Study of "), "p_name", F.lit(" "), "p_type", F.lit(" number "), F.lpad(key.cast("string"), 7, "0")).alias("title"), ident.alias("ident"))
    return cited.join(part, "part").withColumn("raw", F.concat(F.lit("Author A. "), "title", F.lit(". 1995. "), "ident"))


def fulltexts(spark, d):
    """id, text of each order: claims, then the list."""
    listed = refs(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "raw"))).alias("r"))
    numbered = lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "))
    claims = F.array_join(F.transform("r", lambda x: F.concat(F.lit("Claim rests on "), numbered(x), F.lit("here."))), " ")
    several = F.when(F.size("r") >= 3, F.lit(" All of [1-3] and (2) agree.")).otherwise("")
    body = F.concat(F.lit("Work "), F.col("id").cast("string"), F.lit(".\n"), claims, several, F.lit("\nReferences\n"))
    with_numbers = F.array_join(F.transform("r", lambda x: F.concat(numbered(x), x["raw"])), "\n")
    without = F.array_join(F.transform("r", lambda x: x["raw"]), "\n\n")
    return listed.select("id", F.when(F.col("id") % 4 == 3, F.lit(None)).when(F.col("id") % 4 == 1, F.concat(body, without)).otherwise(F.concat(body, with_numbers)).alias("text"))


NUMBERED = "(id % 4 <> 1 AND k >= 2)"


@query("t02_reference_entries", f"WITH {REFS} SELECT id, (n - 1)::INT AS pos, CASE WHEN {NUMBERED} THEN n::VARCHAR END AS label, CASE WHEN {NUMBERED} THEN 'numeric' ELSE 'unmarked' END AS style, raw FROM refs WHERE id % 4 <> 3")
def t02(spark, d):
    """The entries of all reference lists (T-01 to T-03)."""
    return B.references(fulltexts(spark, d), "id", "text")


@query("t06_bibliography_status", """SELECT l_orderkey AS id, CASE WHEN l_orderkey % 4 = 3 THEN 'text_unavailable' ELSE 'parsed' END AS status FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT -1 - doc_id, CASE WHEN coalesce(text, '') = '' THEN 'text_unavailable' WHEN length(text) < 10000 THEN 'short_or_stub' ELSE 'heading_absent' END FROM documents""")
def t06(spark, d):
    """Of the orders' texts and of the documents, which have no lists."""
    docs = table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("id"), "text")
    return B.statuses(fulltexts(spark, d).unionByName(docs), "id", "text")


@query("x15_stated_id", f"WITH {REFS} SELECT id, part, CASE part % 3 WHEN 0 THEN 'arxiv:' || substr(ident, 7) WHEN 1 THEN ident END AS stated FROM refs")
def x15(spark, d):
    return refs(spark, d).select("id", "part", C.stated_id(F.col("raw")).alias("stated"))


def matched(spark, d):
    """id, part, pos, label, style: of each citation the entry that states the part's arXiv id or DOI or holds its title (J-35).

    Parts may share an arXiv id: of several entries that with the most evidence counts, then the first.
    """
    found = B.references(fulltexts(spark, d), "id", "text")
    r = refs(spark, d).select("id", "part", "title", "ident")
    norm = I.title_key(F.col("raw"))
    arxiv = F.col("ident").startswith("arXiv:") & F.concat(F.lit(" "), F.regexp_replace("raw", r"[^0-9.]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.substring("ident", 7, 20), F.lit(" ")))
    doi = F.col("ident").startswith("doi:") & F.lower("raw").contains(F.substring("ident", 5, 40))
    title = (F.length(I.title_key(F.col("title"))) >= C.LEAST_TITLE) & norm.contains(I.title_key(F.col("title")))
    both = r.join(found, "id").where(arxiv | doi | title)
    evidence = (arxiv | doi).cast("int") + title.cast("int")
    return both.groupBy("id", "part").agg(F.min_by(F.struct("pos", "label", "style"), F.struct(-evidence, "pos")).alias("e")).select("id", "part", "e.pos", "e.label", "e.style")


@query("j35_matching_entry", f"WITH {REFS} SELECT id, part, (n - 1)::INT AS pos FROM refs WHERE id % 4 <> 3")
def j35(spark, d):
    return matched(spark, d).select("id", "part", "pos")


def located(spark, d):
    """id, part, style, n_markers, first passage of each citation whose entry is found."""
    both = matched(spark, d).join(fulltexts(spark, d), "id").select("id", "part", "label", "style", "text")

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples():
                body = r.text[: len(r.text) - len(B.block(r.text))]
                at = C.markers(body, r.label, r.style) if r.style != "unmarked" else []
                out.append((r.id, r.part, r.style, len(at), C.passage(body, *at[0]) if at else None))
            yield pd.DataFrame(out, columns=["id", "part", "style", "n_markers", "passage"])

    return both.mapInPandas(run, "id long, part long, style string, n_markers long, passage string")


@query("t09_body_markers", f"WITH {REFS} SELECT id, part, 1 + (k >= 3 AND n <= 3)::BIGINT + (k >= 3 AND n = 2)::BIGINT AS n_markers FROM refs WHERE id % 4 <> 3 AND {NUMBERED}")
def t09(spark, d):
    """How often the body cites each numbered entry, alone or within a range."""
    return located(spark, d).where("style <> 'unmarked'").select("id", "part", "n_markers")


@query("t10_context_status", f"WITH {REFS} SELECT id, part, CASE WHEN id % 4 = 3 THEN 'fulltext_unavailable' WHEN {NUMBERED} THEN 'bibliography_numeric_marker' ELSE 'listed_without_body_marker' END AS status FROM refs")
def t10(spark, d):
    r = refs(spark, d).select("id", "part", "title", "ident").join(fulltexts(spark, d), "id").join(located(spark, d).select("id", "part", "style", "n_markers"), ["id", "part"], "left")
    states = F.contains("text", F.col("ident"))
    titled = I.title_key(F.col("text")).contains(I.title_key(F.col("title")))
    return r.select("id", "part", C.context_status(F.col("style"), F.coalesce("n_markers", F.lit(0)), F.col("text").isNotNull(), states, titled).alias("status"))


def sources(spark, d):
    """id, tex, bbl, bib of each order: the first five references; the last one's key has another body in the .bib file, twice."""
    r = refs(spark, d).where("n <= 5").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "part", "title"))).alias("r"))
    key = lambda x: F.concat(F.lit("p"), x["part"].cast("string"))
    tex = F.array_join(F.transform("r", lambda x: F.concat(F.lit("Point~uses \\citep[see]{"), key(x), F.lit("}. "))), "")
    bbl = F.concat(F.array_join(F.transform("r", lambda x: F.concat(F.lit("\\bibitem{"), key(x), F.lit("} Author A. "), x["title"], F.lit(".\n"))), ""), F.lit("\\end{thebibliography} \\bibitem{no} after the end"))
    entry = lambda x, y: F.concat(F.lit("@article{"), key(x), F.lit(", title = {"), y, F.lit("}, year = {1995}, note = {a {b} c}}\n"))
    bib = F.concat(F.array_join(F.transform("r", lambda x: entry(x, x["title"])), ""), F.lit("@misc{twice, title = {One}}\n@misc{twice, title = {Two}}\n@article{open, title = {never closed}"))
    return r.select("id", tex.alias("tex"), bbl.alias("bbl"), bib.alias("bib"))


@query("t07_latex_entries", f"WITH {REFS} SELECT id, 'p' || part AS key, 'Author A. ' || title || '.' AS body, 1 AS tier FROM refs WHERE n <= 5")
def t07(spark, d):
    """Entries of .bbl lists, then of .bib files; a key whose bodies differ within its tier has none."""
    s = sources(spark, d)
    bbl = C.spread(s, "id", "bbl", C.bbl_entries, "key string, body string").withColumn("tier", F.lit(1))
    return C.agreed(bbl.unionByName(C.spread(s, "id", "bib", C.bibtex_entries, "key string, body string").withColumn("tier", F.lit(2))), "id")


@query("t08_cite_contexts", f"""WITH {REFS}, f AS (SELECT id, least(max(k), 5) AS k FROM refs GROUP BY id)
  SELECT id, 'p' || part AS key, 0 AS occurrence, trim(repeat('Point uses [CITED]. ', (n - 1)::INT) || 'Point uses [CITED:TARGET]. ' || repeat('Point uses [CITED]. ', (f.k - n)::INT)) AS context FROM refs JOIN f USING (id) WHERE n <= 5""")
def t08(spark, d):
    """The passages around each \\cite command, the target marked (also X-16, X-17)."""
    return C.spread(sources(spark, d), "id", "tex", C.cite_contexts, "key string, occurrence int, context string")


@query("x14_bibtex_reference", f"WITH {REFS} SELECT id, part, 'A. Author. ' || title || '. J. 1995. doi:10.1/' || part AS reference FROM refs")
def x14(spark, d):
    made = F.concat(F.lit("@article{k, Author = {A. Author}, title={"), "title", F.lit('}, journal = "J", year={1995}, doi = {10.1/'), F.col("part").cast("string"), F.lit("}, eprint={none}}"))
    return refs(spark, d).select("id", "part", C.of_fields(made).alias("reference"))


@query("j34_title_containment", f"WITH {REFS} SELECT id, part, 1::BIGINT AS n_works FROM refs")
def j34(spark, d):
    """Of each reference how many works' whole titles, of 25 characters or more, it holds. Candidates share the title's last word, its number."""
    r = refs(spark, d).select("id", "part", I.title_key(F.col("raw")).alias("raw"))
    titles = refs(spark, d).select(F.col("part").alias("work"), I.title_key(F.col("title")).alias("title")).distinct().where(F.length("title") >= C.LEAST_TITLE)
    words = r.withColumn("word", F.explode(F.array_distinct(F.split("raw", " "))))
    both = words.join(titles.withColumn("word", F.element_at(F.split("title", " "), -1)), "word").where(F.contains("raw", "title"))
    return both.groupBy("id", "part").agg(F.count_distinct("work").alias("n_works"))

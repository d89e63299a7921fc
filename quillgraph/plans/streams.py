"""Streaming queries, and what needs no graph: pages and dialogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.plans.base import table
from quillgraph.plans.registry import query
from quillgraph.streaming import incremental as I


@query("r05_late_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def r05(spark, d):
    """Every event once, whenever it comes within a week, then counts by type (also R-03)."""
    schema = table(spark, d, "events").schema
    once = I.deduplicated(I.event_stream(spark, d, schema, "events.parquet").select("event_id", "ts", "event_type"), ["event_id"])
    return I.drain(once).groupBy("event_type").agg(F.count("*").alias("n"))


@query("r11_tumbling_counts", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r11(spark, d):
    """Counts by day and type; an extension, not a capability that the graph needs."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("x12_page_meta", r"SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(html, '<title>([^<]*)', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def x12(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


@query("x10_html_to_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g') AS x FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|title)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM a),
  c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS x FROM b)
  SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM c""")
def x10(spark, d):
    return table(spark, d, "pages").select("page_id", F.btrim(T.html_to_text(F.col("html")), F.lit(" \n")).alias("text"))


@query("e01_leader_dedup", """WITH k AS (SELECT doc_id, source, substr(text, 1, 60) AS title, trim(regexp_replace(lower(coalesce(substr(text, 1, 60), '')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
  SELECT min(doc_id) AS id, arg_min(source, doc_id) AS source, arg_min(title, doc_id) AS title, count(*)::INT AS n_versions FROM k GROUP BY CASE WHEN length(t) >= 8 THEN 'title:' || t ELSE doc_id::VARCHAR END""")
def e01(spark, d):
    """Works over all sources; documents have no identifiers and authors, so equal title keys decide."""
    from quillgraph.operators.resolve import dedup

    nothing = F.lit(None).cast("string")
    records = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), "source", F.substring("text", 1, 60).alias("title"), F.lit(None).cast("array<string>").alias("authors"), F.lit(None).cast("int").alias("year"), nothing.alias("url"), nothing.alias("doi"))
    return dedup(records).select("id", "source", "title", "n_versions")

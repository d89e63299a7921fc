"""URL filters: domain and path rules first, then a weighted vocabulary matched by an Aho-Corasick automaton.

Rules fit a host and all its subdomains where the url's path starts with the rule's path; the longest
rule wins. Elsewhere the vocabulary decides: each term found between boundaries (no letter or digit
of ASCII beside it) counts its weight once, and a url whose distinct hits weigh 1 or more is blocked: one
strict term, or several distinct soft ones.

Nulls and odd rows: a null url, or one without `://`, has an empty host and path and fits no rule; the
vocabulary still reads what text there is, a null url is allowed. Repeated rows are judged alike, an
empty table gives an empty result, and columns other than `id_col` and `url_col` are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import batch, table

#: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
STRICT = ("casino", "porn", "xxx", "viagra", "escort", "spam", "malware", "phishing", "warez", "adult")
SOFT = ("free", "bets", "bet", "cheap", "pills", "win", "bonus", "ads", "track", "tracker", "farm", "poker", "loan", "loans", "lottery", "jackpot", "click", "promo")
STRICT_WEIGHT, SOFT_WEIGHT, REJECT_AT = 1.0, 0.5, 1.0
WEIGHTS = {**dict.fromkeys(SOFT, SOFT_WEIGHT), **dict.fromkeys(STRICT, STRICT_WEIGHT)}

ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """One per worker process and vocabulary."""
    built = ahocorasick.Automaton()
    for term in terms:
        built.add_word(term, term)
    built.make_automaton()
    return built


def hits(url: str, terms: tuple[str, ...]) -> set[str]:
    text = url.translate(LOWER)
    found = set()
    for end, term in automaton(terms).iter(text) if terms else ():
        start = end - len(term) + 1
        if (start == 0 or text[start - 1] not in ALNUM) and (end + 1 == len(text) or text[end + 1] not in ALNUM):
            found.add(term)
    return found


def filter_urls(df: DataFrame, id_col: str, url_col: str, rules: Iterable[tuple[str, str]] = RULES, weights: dict[str, float] | None = None, reject_at: float = REJECT_AT) -> DataFrame:
    """id_col, host, path, rule, verdict, terms (distinct hits, sorted), weight of each row."""
    weights = dict(WEIGHTS if weights is None else weights)
    terms = tuple(sorted(weights))
    url = F.col("url")
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tail = F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)")
    path = F.regexp_extract(F.col("tail"), r"^[^?#]*", 0)
    parsed = (
        df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        .withColumn("rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", host)
        .withColumn("tail", tail)
        .withColumn("path", path)
    )
    verdict, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, where = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(slash + where)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    kind = df.schema[id_col].dataType
    out = pa.schema([("id", pa.int64() if kind.typeName() == "long" else pa.int32() if kind.typeName() == "integer" else pa.string()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("ruled", pa.string()), ("terms", pa.list_(pa.string())), ("weight", pa.float64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [sorted(hits(u, terms)) if u else [] for u in rows.column("url").to_pylist()]
            yield batch(out, **{n: rows.column(n) for n in ("id", "host", "path", "rule", "ruled")}, terms=found, weight=[float(sum(weights[t] for t in f)) for f in found])

    judged = parsed.select(F.col("id").cast("string" if out.field("id").type == pa.string() else kind), "host", "path", rule.alias("rule"), verdict.alias("ruled"), "url").mapInArrow(
        judge, f"id {'string' if out.field('id').type == pa.string() else kind.simpleString()}, host string, path string, rule string, ruled string, terms array<string>, weight double"
    )
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("weight") >= reject_at, "block").otherwise("allow")).alias("verdict"), "terms", "weight",
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), "page_id", "url").select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    def term(t: str) -> str:
        return f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"

    weight = " + ".join([f"2 * {term(t)}" for t in STRICT] + [term(t) for t in SOFT])
    fits = lambda d, p: f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    cases = [(fits(r.partition("/")[0], "/" + r.partition("/")[2]), r, v) for r, v in ordered]
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(u, {lower}) AS low, translate(regexp_extract(rest, '^[^/?#]*'), {lower}) AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT *, {weight} AS weight FROM b)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN '{v}'" for c, _, v in cases)} WHEN weight >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM c"""


QUERIES = {"op5_url_filters": op5_url_filters}
ORACLE = {"op5_url_filters": _oracle()}

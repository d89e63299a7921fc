"""Readers and decoders: JSON lines, whole-graph JSON, API dumps, Atom XML, BibTeX and ledgers, each to a DataFrame.

Reading is lenient as the data model asks: unknown fields are dropped, missing ones take their defaults.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTATION = "STRUCT<id: STRING, source: STRING, url: STRING, pdf_url: STRING, doi: STRING, date: STRING, title: STRING>"
PAPER = (
    "id STRING, source STRING, title STRING, abstract STRING, url STRING, year INT, authors ARRAY<STRING>, venue STRING, doi STRING, referenced_works ARRAY<STRING>, cited_by_count LONG, "
    f"full_text STRING, date STRING, date_precision STRING, date_source STRING, abstract_source STRING, pdf_url STRING, type STRING, is_review BOOLEAN, manifestations ARRAY<{MANIFESTATION}>"
)
CONTRIBUTION = "id STRING, paper_id STRING, statement STRING, kind STRING, quote STRING, problem STRING, method STRING, result STRING, claim_ids ARRAY<STRING>, confidence DOUBLE"
CLAIM = "id STRING, paper_id STRING, text STRING, claim_type STRING, evidence STRING, location STRING, confidence DOUBLE, contribution_id STRING"
EDGE = "src STRING, dst STRING, relation STRING, evidence STRING, confidence DOUBLE, source STRING, level STRING"


def json_lines(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """Records of a declared schema, torn lines dropped; a missing file is an empty table."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    return rows.fillna(defaults) if defaults else rows


def papers(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, PAPER, {"cited_by_count": 0, "is_review": False})


def graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """papers, contributions, claims and edges of a whole graph in one JSON document."""
    whole = spark.read.schema(f"topic STRING, papers ARRAY<STRUCT<{_fields(PAPER)}>>, contributions ARRAY<STRUCT<{_fields(CONTRIBUTION)}>>, claims ARRAY<STRUCT<{_fields(CLAIM)}>>, edges ARRAY<STRUCT<{_fields(EDGE)}>>").option("multiLine", True).json(path)
    return {n: whole.select(F.inline(n)) for n in ("papers", "contributions", "claims", "edges")}


def _fields(schema: str) -> str:
    return re.sub(r"(?<=[\s,<])(\w+) (?=[A-Z])|^(\w+) (?=[A-Z])", lambda m: f"{m[1] or m[2]}: ", schema)


def abstract_of(index: Column) -> Column:
    """Text of an inverted index (word to positions): the words by position."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.concat_ws(" ", F.transform(F.array_sort(places), lambda x: x["word"]))


def works_dump(spark: SparkSession, path: str) -> DataFrame:
    """Papers from a dump of works: nested JSON with an inverted abstract, one work a line."""
    schema = (
        "id STRING, display_name STRING, publication_year INT, publication_date STRING, doi STRING, type STRING, cited_by_count LONG, referenced_works ARRAY<STRING>, "
        "abstract_inverted_index MAP<STRING, ARRAY<INT>>, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, primary_location STRUCT<landing_page_url: STRING, pdf_url: STRING, source: STRUCT<display_name: STRING>>"
    )
    norm = lambda c: F.concat(F.lit("openalex:"), F.element_at(F.split(c, "/"), -1))
    w = json_lines(spark, path, schema)
    return w.select(
        norm(F.col("id")).alias("id"), F.lit("openalex").alias("source"), F.col("display_name").alias("title"), abstract_of(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_year").alias("year"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("primary_location.source.display_name").alias("venue"), "doi", F.transform("referenced_works", norm).alias("referenced_works"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.col("publication_date").alias("date"), F.col("primary_location.pdf_url").alias("pdf_url"), "type", (F.col("type") == "review").alias("is_review"),
    )


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Papers of an Atom feed: id, title, abstract, authors, date, year."""
    schema = "id STRING, title STRING, summary STRING, published STRING, author ARRAY<STRUCT<name: STRING>>"
    x = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    ident = F.regexp_replace(F.regexp_extract("id", r"abs/(.+)$", 1), r"v\d+$", "")
    return x.select(F.concat(F.lit("arxiv:"), ident).alias("id"), clean(F.col("title")).alias("title"), clean(F.col("summary")).alias("abstract"), F.transform("author", lambda a: a["name"]).alias("authors"), F.left("published", F.lit(10)).alias("date"), F.left("published", F.lit(4)).cast("int").alias("year"))


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """kind, key and fields of each entry; braces may nest, quotes may stand for them."""
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s}]+)\s*,", text):
        fields: dict[str, str] = {}
        at = m.end()
        while (f := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(text, at)) is not None:
            at = f.end()
            if text[at : at + 1] == "{":
                depth, end = 1, at + 1
                while end < len(text) and depth:
                    depth += {"{": 1, "}": -1}.get(text[end], 0)
                    end += 1
                value = text[at + 1 : end - 1]
            elif text[at : at + 1] == '"':
                end = text.find('"', at + 1)
                end = len(text) if end < 0 else end + 1
                value = text[at + 1 : end - 1]
            else:
                end = re.compile(r"[^,}\s]*").match(text, at).end()
                value = text[at:end]
            fields[f[1].lower()] = " ".join(value.replace("{", "").replace("}", "").split())
            at = end
        yield m[1].lower(), m[2], fields


def bibtex(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, title, year, doi, fields of the entries of .bib files; a file is read whole by one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(k, key, f.get("title"), f.get("year"), f.get("doi"), f) for text in rows["value"] for k, key, f in bibtex_entries(text)]
            yield pd.DataFrame(found, columns=["kind", "key", "title", "year", "doi", "fields"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "kind string, key string, title string, year string, doi string, fields map<string, string>")


def identifiers(spark: SparkSession, path: str) -> DataFrame:
    """id, kind of the lines of an identifier list; comments and blank lines are skipped."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("id"), F.when(line.rlike(r"^10\.\d{4,9}/"), "doi").when(line.rlike(r"\d{4}\.\d{4,5}"), "arxiv").otherwise("other").alias("kind"))

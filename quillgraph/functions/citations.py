"""Where texts cite: LaTeX bibliographies and \\cite commands, markers in plain text, passages around them, and stated identities.

A null text has nothing; of two entries with one key and different bodies neither counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and widths as the results require them.
CITE = re.compile(r"\\cite[a-z]*\*?(?:\[[^\]]*\])?\{([^}]*)\}")
COMMAND = re.compile(r"\\[a-zA-Z]+\*?(\[[^\]]*\])?")
NUMBERS = re.compile(r"(?:\[\s*\d{1,4}(?:\s*[-–—,;]\s*\d{1,4})*\s*\]|\(\s*\d{1,3}\s*\))")
BIBITEM = re.compile(r"\\bibitem(?:\[[^\]]*\])?\{([^}]+)\}")
STATED_ARXIV = r"(?i)arxiv[:\s]*(\d{4}\.\d{4,5})(?:v\d+)?"
STATED_DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)"
FIELD = r"(\w+)\s*=\s*[{\"]([^{}\"]*)[}\"]"
LATEX_WINDOW, TEXT_WINDOW, MOST_CONTEXTS, MOST_PASSAGES, LEAST_TITLE = 320, 500, 2, 5, 25


def plain(text: str, target: int | None = None) -> str:
    """LaTeX as text: citations become [CITED], the one that begins at `target` [CITED:TARGET]."""
    text = CITE.sub(lambda m: "[CITED:TARGET]" if m.start() == target else "[CITED]", text)
    return " ".join(re.sub(r"[{}$~%]", " ", COMMAND.sub(" ", text)).split())


def passage(text: str, start: int, end: int, width: int = TEXT_WINDOW) -> str:
    return " ".join(text[max(0, start - width) : end + width].split())


def bbl_entries(text: str) -> list[tuple[str, str]]:
    """(key, body) of each \\bibitem, up to the next or the end of the list."""
    text = text.split(r"\end{thebibliography}")[0]
    marks = list(BIBITEM.finditer(text))
    return [(m[1].strip(), " ".join(text[m.end() : n].split())) for m, n in zip(marks, [*(m.start() for m in marks[1:]), len(text)], strict=True)]


def bibtex_entries(text: str) -> list[tuple[str, str]]:
    """(key, body) of each BibTeX entry whose braces balance."""
    out = []
    for m in re.finditer(r"@[a-zA-Z]+\s*\{\s*([^,\s]+)\s*,", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        if not depth:
            out.append((m[1], text[m.start() : at]))
    return out


def cite_contexts(tex: str) -> list[tuple[str, int, str]]:
    """(key, occurrence from 0, context) of each cited key, its first occurrences."""
    seen: dict[str, int] = {}
    out = []
    for m in CITE.finditer(tex):
        first, last = max(0, m.start() - LATEX_WINDOW), m.end() + LATEX_WINDOW
        for key in dict.fromkeys(k.strip() for k in m[1].split(",")):
            n = seen.get(key, 0)
            if n < MOST_CONTEXTS:
                out.append((key, n, plain(tex[first:last], m.start() - first)))
                seen[key] = n + 1
    return out


def markers(body: str, label: str, style: str) -> list[tuple[int, int]]:
    """Where a body cites the entry of this label: numbers alone, in lists and in ranges, or a surname with the year after it."""
    if style == "numeric":
        n, out = int(label), []
        for m in NUMBERS.finditer(body):
            values = [int(x) for x in re.findall(r"\d{1,4}", m[0])]
            if n in values or any(a < n < b for a, b in zip(values, values[1:], strict=False)):
                out.append(m.span())
        return out
    if style == "author_year":
        name, year = label.split("|", 1)
        return [m.span() for m in re.finditer(rf"\b{re.escape(name.split()[0])}(?:\s+et\s+al\.)?[^.\n]{{0,45}}?\b{re.escape(year)}\b", body, re.I)]
    return []


def spread(df: DataFrame, ident: str, text: str, found: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """ident and a row of `schema` for each tuple that `found` makes of the text."""
    names = [ident, *(part.strip().split()[0] for part in schema.split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(rows[ident], rows[text], strict=True) if t for x in found(t)], columns=names)

    return df.select(ident, text).mapInPandas(run, f"{ident} {df.schema[ident].dataType.simpleString()}, {schema}")


def agreed(entries: DataFrame, ident: str) -> DataFrame:
    """ident, key, body, tier of entries (tier: smaller is trusted more): of each key the best tier's body, if that tier has one body only."""
    best = entries.groupBy(ident, "key").agg(F.min("tier").alias("tier"))
    own = entries.join(best, [ident, "key", "tier"])
    return own.groupBy(ident, "key", "tier").agg(F.min("body").alias("body"), F.count_distinct("body").alias("bodies")).where("bodies = 1").select(ident, "key", "body", "tier")


def stated_id(raw: Column) -> Column:
    """`arxiv:` or `doi:` with the first id that a reference states, arXiv first; null for none."""
    arxiv, doi = F.regexp_extract(raw, STATED_ARXIV, 1), F.regexp_extract(raw, STATED_DOI, 1)
    return F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)).when(doi != "", F.concat(F.lit("doi:"), doi))


def of_fields(reference: Column) -> Column:
    """A reference from BibTeX fields: author, title, venue, year, then DOI and arXiv id; empty without a title."""
    names, values = F.regexp_extract_all(reference, F.lit(FIELD), F.lit(1)), F.regexp_extract_all(reference, F.lit(FIELD), F.lit(2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(F.lower(k).alias("k"), F.trim(v).alias("v")))

    def named(key: str) -> Column:
        return F.filter(pairs, lambda p: p["k"] == key)

    def field(*keys: str) -> Column:
        """The first of the fields that is given and not empty; of one that repeats the last."""
        return F.coalesce(*[F.nullif(F.try_element_at(named(key), F.lit(-1))["v"], F.lit("")) for key in keys])

    eprint = field("eprint", "arxiv")
    tail = F.concat(F.coalesce(F.concat(F.lit(" doi:"), field("doi")), F.lit("")), F.coalesce(F.when(eprint.rlike(r"^\d{4}\.\d{4,5}"), F.concat(F.lit(" arXiv:"), eprint)), F.lit("")))
    whole = F.concat(F.concat_ws(". ", field("author"), field("title"), field("journal", "booktitle"), field("year")), F.lit("."), tail)
    return F.when(field("title").isNotNull(), whole).otherwise("")


def context_status(entry_style: Column, n_markers: Column, has_text: Column, states_arxiv: Column, states_title: Column) -> Column:
    """How far a citation's passage is known: by markers of its entry, by the entry only, by an id or the title in the text, or not."""
    return (
        F.when(~has_text, "fulltext_unavailable")
        .when((n_markers > 0) & (entry_style != "unmarked"), F.concat(F.lit("bibliography_"), entry_style, F.lit("_marker")))
        .when(entry_style.isNotNull(), "listed_without_body_marker")
        .when(states_arxiv, "exact_arxiv_id")
        .when(states_title, "exact_normalized_title")
        .otherwise("context_unavailable")
    )

"""Identity of works: title keys, work ids, identifiers in text, and the predicate that two records are one work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A title shorter than this identifies nothing.
LEAST_TITLE = 8
ARXIV = r"(\d{4}\.\d{4,5})"
DOI = r"(10\.\d{4,9}/[^\s\"<>]+)"


def title_key(title: Column) -> Column:
    """Lower-cased ASCII letters and digits; everything else is one space."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def key(title: Column, ident: Column) -> Column:
    t = title_key(F.coalesce(title, F.lit("")))
    return F.when(F.length(t) >= LEAST_TITLE, F.concat(F.lit("title:"), t)).otherwise(ident)


def work_id(title: Column, ident: Column) -> Column:
    k = key(title, ident)
    return F.when(k.startswith("title:"), F.concat(F.lit("work:"), F.substring(F.sha1(k), 1, 16))).otherwise(ident)


def doi(text: Column) -> Column:
    """The bare, lower-cased DOI, without resolver, prefix and trailing points or slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", ""), r"[./\s]+$", "")


def arxiv(text: Column) -> Column:
    """The bare arXiv id: prefix and path dropped, cut at the first v."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^arxiv:|^https?://arxiv\.org/(abs|pdf)/", "")
    return F.substring_index(F.regexp_replace(bare, r"\.pdf$", ""), "v", 1)


def arxiv_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, ARXIV, 1), F.lit(""))


def aliases(*fields: Column) -> Column:
    """Sorted distinct `arxiv:` and `doi:` names in the fields; an arXiv DOI counts as both."""
    text = F.lower(F.concat_ws(" ", *fields))
    ids = F.transform(F.regexp_extract_all(text, F.lit(ARXIV), F.lit(1)), lambda x: F.concat(F.lit("arxiv:"), x))
    dois = F.transform(F.regexp_extract_all(text, F.lit(DOI), F.lit(1)), lambda x: F.concat(F.lit("doi:"), F.regexp_replace(x, r"[.,;)/]+$", "")))
    return F.array_sort(F.array_distinct(F.concat(ids, dois)))


def namespace(alias: Column) -> Column:
    return F.substring_index(alias, ":", 1)


def spaces(aliases: Column) -> Column:
    return F.array_distinct(F.transform(aliases, namespace))


def spaces_mask(aliases: Column) -> Column:
    """1 for arxiv and 2 for doi, added, of what `aliases` gives: sorted names of these two."""
    first, last = F.get(aliases, F.lit(0)), F.get(aliases, F.size(aliases) - 1)
    return F.coalesce(first.startswith("arxiv:"), F.lit(False)).cast("int") + F.coalesce(last.startswith("doi:"), F.lit(False)).cast("int") * 2


def close(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Titles of six words or more whose smaller is contained to 0.88, with a common surname and years at most two apart."""
    both = F.size(F.array_intersect(a["tokens"], b["tokens"])) / F.least(F.size(a["tokens"]), F.size(b["tokens"]))
    return F.coalesce(
        (F.least(F.size(a["tokens"]), F.size(b["tokens"])) >= 6)
        & (both >= 0.88)
        & F.arrays_overlap(a["surnames"], b["surnames"])
        & (a["year"].isNull() | b["year"].isNull() | (F.abs(a["year"] - b["year"]) <= 2)),
        F.lit(False),
    )


def same_work(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of two records with aliases, key, tokens (distinct title words), surnames and year: whether they are one work.

    A shared alias says yes; without one, aliases of one namespace on both sides say no; then equal keys say yes; then `close`.
    """
    return (
        F.when(F.arrays_overlap(a["aliases"], b["aliases"]), True)
        .when(F.arrays_overlap(spaces(a["aliases"]), spaces(b["aliases"])), False)
        .when(a["key"] == b["key"], True)
        .otherwise(close(a, b))
    )


def surname(author: Column) -> Column:
    return F.element_at(F.split(F.trim(author), r"\s+"), -1)


def short_cite(authors: Column, year: Column) -> Column:
    """Surname of the first author with et al. for more than one, and the year."""
    name = F.when(F.size(authors) > 0, surname(F.try_element_at(authors, F.lit(1)))).otherwise(F.lit("Unknown"))
    return F.concat(name, F.when(F.size(authors) > 1, F.lit(" et al.")).otherwise(F.lit("")), F.lit(" "), F.coalesce(year.cast("string"), F.lit("n.d.")))


def paper_of(node_id: Column) -> Column:
    return F.substring_index(node_id, "::", 1)

"""Reference lists in full texts: the block, its entries with their labels, blobs of many references, and why a text has none."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Patterns of headings, markers and notices, and bounds, as the results require them.
HEADING = re.compile(r"^[\s0-9.]*(references|bibliography|works\s+cited|references\s+cited)\s*$", re.I | re.M)
MENTION = re.compile(r"\b(references|bibliography|works\s+cited)\b", re.I)
BRACKET = re.compile(r"\[\s*(\d{1,4})\s*\]")
PAREN = re.compile(r"(?:^|\n)\s*\(\s*(\d{1,4})\s*\)\s*", re.M)
AUTHOR_YEAR = re.compile(r"(?<!\w)([A-Z][A-Za-z'’\-]{1,40}(?:\s+et\s+al\.?)?)\s*[([]\s*((?:19|20)\d{2}[a-z]?)\s*[)\]]")
APPENDIX = re.compile(r"(?im)^\s*(?:appendix(?:\s+[A-Z0-9].*)?|supplementary(?:\s+(?:material|information).*)?)\s*$")
LINE_MARKERS = (re.compile(r"(?m)^\s*\[(\d{1,4})\]\s+"), re.compile(r"(?m)^\s*(\d{1,4})[.)]\s+"), re.compile(r"(?m)^\s*\((\d{1,4})\)\s+"))
FIRST_MARKER = re.compile(r"^\s*(?:\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4}[.)])\s+")
YEAR = re.compile(r"\b(19|20)\d{2}\b")
BIBTEX = re.compile(r"@[a-zA-Z]+\s*\{")
BIBITEM = re.compile(r"\\bibitem\b")
NAVIGATION = re.compile(
    r"(?:purchase details|change username|show more references|references is not available|conversion report|report an issue|view original on arxiv|copyright privacy policy)",
    re.I,
)
LEAST_LENGTH, MOST_ENTRIES, MOST_LENGTH, STUB = 20, 500, 5000, 10_000

Entry = tuple[str | None, str, str]


def clean(text: str) -> str:
    return " ".join(text.split())


def block(text: str) -> str:
    """What follows the last heading that entries follow, else the last heading, else a late mention that a reference follows; up to an appendix."""
    heads = [m.end() for m in HEADING.finditer(text)]
    listed = [at for at in heads if sum(len(mark.findall(text[at : at + 2000])) for mark in (BRACKET, PAREN, AUTHOR_YEAR)) >= 2]
    late = [] if heads else [m.end() for m in MENTION.finditer(text, int(len(text) * 0.35)) if any(mark.search(text[m.end() : m.end() + 240]) for mark in (BRACKET, PAREN, AUTHOR_YEAR, YEAR))]
    starts = listed or heads or late
    if not starts:
        return ""
    after = text[starts[-1] :]
    cut = APPENDIX.search(after)
    return after[: cut.start()] if cut else after


def plausible(entry: str) -> bool:
    """Between markers: enough letters, and some punctuation or identifier."""
    return len(entry) >= LEAST_LENGTH and len(re.findall("[A-Za-z]", entry)) >= 12 and re.search(r"[.?!:]|\b(?:doi|arxiv|https?)\b", entry, re.I) is not None


def dated(entry: str) -> bool:
    return len(entry) >= LEAST_LENGTH and YEAR.search(entry) is not None


def between(text: str, marks: list[re.Match], keep_mark: bool) -> list[tuple[re.Match, str]]:
    ends = [m.start() for m in marks[1:]] + [len(text)]
    found = ((m, clean(text[m.start() if keep_mark else m.end() : end])) for m, end in zip(marks, ends, strict=False))
    return [(m, raw) for m, raw in found if plausible(raw)]


def unmarked(text: str) -> list[str]:
    """By line markers of one kind, at least two, or by blank lines; entries with a year."""
    pieces = re.split(r"\n\s*\n", text)
    for marker in LINE_MARKERS:
        starts = [m.start() for m in marker.finditer(text)]
        if len(starts) >= 2:
            pieces = [marker.sub(" ", text[a:b], count=1) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
            break
    return [e for e in (FIRST_MARKER.sub("", clean(p)) for p in pieces) if dated(e.strip())]


def entries(text: str) -> list[Entry]:
    """(label, style, entry) of a block. A run of numbers that counts up nearly without fail wins over names with years, these over a weaker run, then unmarked entries."""
    near = lambda marks: len(marks) >= 2 and marks[0].start() < 300
    numbers = list(BRACKET.finditer(text))
    if not near(numbers):
        numbers = list(PAREN.finditer(text))
    values = [int(m[1]) for m in numbers]
    rises = sum(a < b for a, b in zip(values, values[1:], strict=False))
    names = list(AUTHOR_YEAR.finditer(text))
    numeric = lambda: [(m[1], "numeric", raw) for m, raw in between(text, numbers, False)]
    ways = (
        (len(values) >= 3 and values[0] <= 5 and rises >= len(values) - 2, numeric),
        (near(names), lambda: [(f"{m[1]}|{m[2]}", "author_year", raw) for m, raw in between(text, names, True)]),
        (near(numbers) and rises >= min(2, len(values) - 1), numeric),
    )
    for fits, found in ways:
        if fits and len(out := found()) >= 2:
            return out[:MOST_ENTRIES]
    return [(None, "unmarked", e) for e in unmarked(text)][:MOST_ENTRIES]


def of_text(text: str | None) -> list[Entry]:
    part = block(text or "")
    return entries(part) if part else []


def status(text: str | None) -> str:
    """Why a text's reference list can be used or not."""
    if not text:
        return "text_unavailable"
    if any(not NAVIGATION.search(raw) for _, _, raw in of_text(text)):
        return "parsed"
    if len(text) < STUB:
        return "short_or_stub"
    if not MENTION.search(text):
        return "heading_absent"
    return "reference_block_unsegmented" if block(text) else "heading_without_reference_block"


def split_blob(blob: str) -> list[str]:
    """The references of a field that holds many: BibTeX entries or \\bibitems, else as an unmarked list."""
    pieces = re.split(r"(?=@[a-zA-Z]+\s*\{)", blob) if BIBTEX.search(blob) else [blob] if BIBITEM.search(blob) else []
    found = [FIRST_MARKER.sub("", clean(x)) for p in pieces for x in BIBITEM.split(p)]
    good = [e for e in found if dated(e.strip())]
    return good if len(good) >= 2 else unmarked(blob)


def references_for(mined: list[str] | None, text: str | None) -> list[str]:
    """Mined references where there are any, else those of the text's list; blobs are split, each reference comes once."""
    known = [r.strip() for r in mined or [] if r and r.strip()] if mined else [raw for _, _, raw in of_text(text)]
    whole = [x for r in dict.fromkeys(known) for x in ([r] if len(r) <= MOST_LENGTH else split_blob(r))]
    return list(dict.fromkeys(r for r in whole if r and len(r) <= MOST_LENGTH))[:MOST_ENTRIES]


def references(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, pos, label, style, raw: a row for each entry of each text's reference list. Null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, n, *e) for i, t in zip(rows[ident], rows[text], strict=True) for n, e in enumerate(of_text(t))]
            yield pd.DataFrame(out, columns=[ident, "pos", "label", "style", "raw"])

    return docs.select(ident, text).mapInPandas(run, f"{ident} {docs.schema[ident].dataType.simpleString()}, pos int, label string, style string, raw string")


def statuses(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """ident, status of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({ident: rows[ident], "status": [status(t) for t in rows[text]]})

    return docs.select(ident, text).mapInPandas(run, f"{ident} {docs.schema[ident].dataType.simpleString()}, status string")

"""HTML extraction by the maximum-scoring subsequence of a page's words and tags.

A page is a sequence of tokens: each word scores positive, each tag scores zero or less, by weights that are
learned from labelled pages (those whose markup says where the content is: one `article` or `main`
element). A word's weight is the log odds of words inside that element over words outside; a tag's weight is the
log odds of its own name, but never above zero. One linear scan finds the contiguous region of highest score.
Parts that hold no content wherever they stand (scripts, menus, footers, forms, advertisements, notices,
reader comments, by element name or by class, id and role, if all words of a compound name agree) score nothing and are left out of the
region's text. Where a page has elements for its content, the edges of the outermost ones bound regions and tags within cost
nothing, nor do tags that only style text: such markup says itself what it holds. All of a page's content elements are one
region, with all they hold, which competes with the regions outside of them.

Learning counts tokens over all labelled pages by one small aggregation (a row per standard tag name and partition; other names
share one). On pages without such elements the scan alone finds the region, by what the labelled ones taught.

Text: character references are decoded, white space in a block is turned into one space and trimmed, and
blocks are joined by one space in page order.

Nulls and odd rows: null or empty html gives an empty text; an unclosed element ends with its parent or the page,
an unclosed comment, script or tag ends with the page; without any labelled page the default weights hold. Repeated
rows are treated alike; an empty table gives an empty result; columns other than those named are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import batch, table

#: Elements whose content is no text of the page.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "canvas")
#: Elements that hold no main text, wherever they stand.
DROPPED = frozenset((*RAW, "head", "nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "input", "option"))
#: Words in class, id or role that mark an element as no main text.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside related recommended share sharing social widget toolbar search login "
    "comment comments comment-list commentlist discussion disqus replies reply respond complementary contentinfo".split()
)
#: Words that may stand beside those in a compound name (`comment-list`); with any other word the name says something else (`related-work`).
BESIDE = frozenset(
    "a all area articles bar body block bottom box button buttons card cell column container content count dark entry fixed form global group hidden icon icons "
    "inline inner item items layout left light link links list main mobile outer page panel post posts primary right row secondary section site small sticky stories strip text thread title top unit user users view wrap wrapper zone".split()
)
#: Names of elements that have weights of their own (fixed list, those of the HTML standard); other names share one.
NAMES = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee math menu meta meter nav "
    "noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
OTHER = "other"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = ("article", "main")
DEFAULT_WORD, DEFAULT_TAG = 1.0, -3.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


def marked(attributes: str) -> bool:
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for word in re.split(r"\s+", html.unescape(a or b or c).lower()):
            parts = [p for p in re.split(r"[-_]+|\d+", word) if p]
            if word in MARKED or any(p in MARKED for p in parts) and all(p in MARKED or p in BESIDE for p in parts):
                return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(tag name with a slash if it closes, or empty; text; whether it stands in a part that is dropped)."""
    out: list[tuple[str, str, bool]] = []
    dropped, depth, inner, at, n = "", 0, 0, 0, len(page)
    for_text = lambda a, b: out.append(("", page[a:b], bool(dropped))) if b > a else None
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            for_text(at, n)
            break
        for_text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # the page ends within a tag
            break
        name, closes = m[2].lower(), bool(m[1])
        if dropped:
            # Within a dropped part, its own name opens and closes levels; the content's end closes all of it, but not the end of content that it holds itself.
            if name in CONTENT and dropped not in ("p", "head") and (inner or not closes):
                inner += -1 if closes else 1
                continue
            if name == dropped and name not in VOID:
                depth += -1 if closes else 1
            if depth == 0 or (closes and name in (*CONTENT, "body", "html")) or (name in CONTENT and not closes and dropped in ("p", "head")) or (dropped == "head" and name == "body") or (dropped == "p" and depth > 1):
                dropped, depth, inner = "", 0, 0
                out.append((f"/{name}" if closes else name, "", False))
            continue
        if not closes and (name in DROPPED or name not in (*CONTENT, "body", "html") and marked(m[3])):
            if name not in VOID and not m[3].endswith("/"):
                dropped, depth = name, 1
            out.append((name, "", True))
            if name in RAW_END:
                end = RAW_END[name].search(page, at)
                at, dropped, depth = (end.end() if end else n), "", 0
            continue
        out.append((f"/{name}" if closes else name, "", False))
    return out


def count(page: str) -> tuple[Counter, Counter, int, int]:
    """Of a page with one content element: its tags inside and outside of it, and its words inside and outside."""
    inside, outside, words = Counter(), Counter(), [0, 0]
    parts = tokens(page)
    name = next((c for c in CONTENT if sum(t[0] == c for t in parts) == 1), None)
    if name is None:
        return inside, outside, 0, 0
    within = False
    for tag, text, off in parts:
        if tag == name or tag == f"/{name}":
            within = tag == name
        elif tag:
            (inside if within and not off else outside)[tag.lstrip("/")] += 1
        else:
            words[within and not off] += len(text.split())
    return inside, outside, words[1], words[0]


def learn(df: DataFrame, html_col: str) -> tuple[float, dict[str, float]]:
    """The weight of a word and of each tag name, from all pages of df that are labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for rows in batches:
            for page in rows.column(0):
                a, b, words_in, words_out = count(page.as_py() or "")
                for total, tags in ((inside, a), (outside, b)):
                    for tag, n in tags.items():
                        total[named(tag)] += n
                inside[""] += words_in
                outside[""] += words_out
        names = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[x] for x in names], pa.int64()), pa.array([outside[x] for x in names], pa.int64())], names=["tag", "n_in", "n_out"])

    rows = df.select(F.col(html_col).alias("html")).mapInArrow(run, "tag string, n_in long, n_out long").groupBy("tag").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    # A row a name of NAMES, one for the others and one for words.
    found = {r.tag: (r.n_in, r.n_out) for r in rows.collect()}
    odds = lambda a, b: math.log((a + 1) / (b + 1))
    a, b = found.pop("", (0, 0))
    if not a:
        return DEFAULT_WORD, {}
    return max(0.1, odds(a, b)), {tag: min(0.0, odds(*counts)) for tag, counts in found.items()}


def named(tag: str) -> str:
    """The name under which a tag has its weight."""
    return tag if tag in NAMES else OTHER


def region(parts: list[tuple[str, str, bool]], word: float, tags: dict[str, float]) -> list[tuple[int, int]]:
    """The half-open ranges of tokens with the highest sum: one outside of the content elements, or all of these. Of equals the first and longest."""
    best, best_range, total, start = 0.0, (0, 0), 0.0, 0
    content, ranges, opened = 0.0, [], []
    for i, (tag, text, off) in enumerate(parts):
        name = tag.lstrip("/")
        if name in CONTENT or (opened and tag in ("/body", "/html")):
            was = bool(opened)
            if name == tag:
                opened.append(name)
            elif name not in CONTENT:
                opened.clear()
            elif name in opened:
                # What is open within ends too.
                while opened.pop() != name:
                    pass
            if was and not opened:
                ranges.append((start, i))
            if not (was and opened):
                total, start = 0.0, i + 1
            continue
        gain = 0.0 if off or tag else word * len(text.split())
        if opened:
            content += gain
            continue
        if total < 0:
            total, start = 0.0, i
        total += gain if not tag or off or name in INLINE else tags.get(named(name), DEFAULT_TAG)
        if total > best or (total == best and best > 0 and start == best_range[0]):
            best, best_range = total, (start, i + 1)
    if opened:
        ranges.append((start, len(parts)))
    if content > best or (content == best and best > 0 and ranges[0] < best_range):
        return ranges
    return [best_range]


def extract(page: str | None, word: float = DEFAULT_WORD, tags: dict[str, float] | None = None) -> str:
    parts = tokens(page or "")
    blocks, block = [], []
    for first, last in region(parts, word, tags or {}):
        for tag, text, off in parts[first:last]:
            if tag:
                if tag.lstrip("/") not in INLINE:
                    blocks.append("".join(block))
                    block = []
            elif not off:
                block.append(text)
        blocks.append("".join(block))
        block = []
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in clean if b)


def extract_main_text(df: DataFrame, id_col: str, html_col: str, url_col: str, weights: tuple[float, dict[str, float]] | None = None) -> DataFrame:
    """id_col, url_col, text, n_chars of each page; weights as learn() gives them, else learned from df itself."""
    word, tags = weights or learn(df, html_col)
    kind = df.schema[id_col].dataType.simpleString()
    out = pa.schema([("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                texts = [extract(p.as_py(), word, tags) for p in part.column(2)]
                made = batch(out, text=texts, n_chars=[len(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made.columns], names=["id", "url", "text", "n_chars"])

    found = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return found.withColumnsRenamed({"id": id_col, "url": url_col})


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"), "page_id", "html", "url")


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLE: dict[str, str] = {}

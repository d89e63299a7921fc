"""HTML to Markdown: headings, lists, tables, formulas by their alternative text, images, emphasis."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

DROPPED = {"script", "style", "svg", "nav"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "header", "footer", "blockquote", "figure", "figcaption"}
MARKS = {"em": "*", "i": "*", "strong": "**", "b": "**", "code": "`"}
LISTS = {"ul", "ol"}
#: Classes of tables that hold displayed equations, and of their numbers.
EQUATIONS, NUMBER = "ltx_eqn_table", "ltx_eqn_eqno"


class Element:
    """An open element: its Markdown so far, and what its children hand up to it: cells or rows, formulas, a number."""

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs = tag, attrs
        self.parts: list[str] = []
        self.items: list = []
        self.formulas: list[str] = []
        self.number, self.count, self.headed = "", 0, False

    @property
    def equations(self) -> bool:
        return self.tag == "table" and EQUATIONS in (self.attrs.get("class") or "")


class Markdown(HTMLParser):
    """Elements are written when they close, each into the one around it, so depth costs no recursion; what is left open closes at the end."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Element("", {})]

    def handle_starttag(self, tag, attrs):
        element = Element(tag, dict(attrs))
        if tag in VOID:
            self.write(self.void(element))
        else:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open[1:]):
            while self.close_last() != tag:
                pass

    def handle_data(self, data):
        self.write(re.sub(r"[ \t\r\n]+", " ", data), data=True)

    def close_last(self) -> str:
        element = self.open.pop()
        self.write(self.closed(element, "".join(element.parts)))
        return element.tag

    def write(self, text: str, data: bool = False) -> None:
        parts = self.open[-1].parts
        if data and (parts[-1].endswith("\n") if parts else self.open[-1].tag in BLOCKS | {"li", ""}):
            text = text.lstrip(" ")
        if text:
            parts.append(text)

    def around(self, *tags: str) -> Element | None:
        """The innermost open element of these tags; a table hides those around it."""
        for e in reversed(self.open):
            if e.tag in tags:
                return e
            if e.tag == "table":
                return None
        return None

    @staticmethod
    def void(e: Element) -> str:
        if e.tag == "br":
            return "\n"
        src = e.attrs.get("src") or e.attrs.get("data-src")
        if e.tag == "img" and src and not src.startswith("data:"):
            return f"\n\n![{e.attrs.get('alt') or ''}]({src})\n\n"
        return ""

    def closed(self, e: Element, text: str) -> str:
        tag = e.tag
        if tag in DROPPED:
            return ""
        if tag == "math":
            return self.formula(e)
        if tag in MARKS:
            return f"{MARKS[tag]}{text}{MARKS[tag]}"
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {text.strip()}\n\n"
        if tag == "li":
            lists = [x for x in self.open if x.tag in LISTS]
            mark = "-"
            if lists and lists[-1].tag == "ol":
                lists[-1].count += 1
                mark = f"{lists[-1].count}."
            return f"\n{'  ' * max(0, len(lists) - 1)}{mark} {text.lstrip(' ')}"
        if tag in LISTS:
            return f"{text}\n"
        if tag in ("td", "th") and (row := self.around("tr")) is not None:
            if NUMBER in (e.attrs.get("class") or ""):
                row.number += text
            row.items.append(" ".join(text.split()))
            row.headed |= tag == "th"
            return ""
        if tag == "tr" and (table := self.around("table")) is not None:
            table.items.append(e)
            return ""
        if tag == "table":
            return self.equations(e) if e.equations else self.table(e, text)
        return f"\n\n{text}\n\n" if tag in BLOCKS else text

    def formula(self, e: Element) -> str:
        latex = (e.attrs.get("alttext") or "").strip()
        if not latex:
            return ""
        row, table = self.around("tr"), next((x for x in reversed(self.open) if x.tag == "table"), None)
        if table is not None and table.equations:
            if row is not None:
                row.formulas.append(latex)
            return ""
        return f"\n\n$$\n{latex}\n$$\n\n" if e.attrs.get("display") == "block" else f" ${latex}$ "

    @staticmethod
    def equations(table: Element) -> str:
        found = []
        for row in table.items:
            if row.formulas:
                number = re.sub(r"^\((.*)\)$", r"\1", row.number.strip()).strip()
                found.append(f"$$\n{' '.join(row.formulas)}" + (f" \\tag{{{number}}}" if number else "") + "\n$$")
        return "\n\n" + "\n\n".join(found) + "\n\n" if found else ""

    @staticmethod
    def table(table: Element, text: str) -> str:
        """A first row is the head if the table has head cells; what stands outside of rows comes before."""
        rows = [r.items for r in table.items if r.items]
        if not rows:
            return text
        width = max(map(len, rows))
        rows = [[c.replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
        if not any(r.headed for r in table.items):
            rows.insert(0, [""] * width)
        rows.insert(1, ["---"] * width)
        return text.rstrip(" ") + "\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n\n"


def to_markdown(html: str | None) -> str:
    """Empty for null and for pages without content; else ends with one line end."""
    parser = Markdown()
    parser.feed(html or "")
    parser.close()
    while len(parser.open) > 1:
        parser.close_last()
    text = re.sub(r"(?<=\S) {2,}", " ", "".join(parser.open[0].parts))
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()
    return text + "\n" if text else ""


def markdown(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """ident, markdown of each page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({ident: rows[ident], "markdown": [to_markdown(h) for h in rows[html]]})

    return pages.select(ident, html).mapInPandas(run, f"{ident} {pages.schema[ident].dataType.simpleString()}, markdown string")

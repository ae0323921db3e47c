"""The Python operators: tolerant HTML parsing, one struct per page, as columns of Arrow batches.

A page is read in one pass. Blocks and paragraphs are kept as ranges over the page's links and as
differences of running word counts, so a page costs time in proportion to its length however its
tags nest.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quellwerk.functions import constants as K

_SILENT = ("script", "style", "template", "rt", "rp")
_BLOCKS = {"p", "li", "h3", "h4"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A new one of these ends an open one of the same kind, unless a container was opened since.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_CONTAINERS = {"ul", "ol", "table", "div", "article", "body"}
_TOKEN = re.compile(K.TOKEN)


class OpenTags(HTMLParser):
    """Which elements are open, by place and by tag; ends elements that a tag closes implicitly."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, object]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.containers: list[int] = []

    def opened(self, tag: str, attrs: dict[str, str]) -> object:
        """Called for every start tag; what it returns is handed to closed()."""

    def closed(self, tag: str, state: object) -> None:
        """Called when an element ends; never for those without content."""

    def end_from(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, state = self.open.pop()
            self.places[tag].pop()
            if tag in _CONTAINERS:
                self.containers.pop()
            self.closed(tag, state)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        near = max((self.places[t][-1] for t in _CLOSES.get(tag, ()) if self.places[t]), default=-1)
        if near >= 0 and (not self.containers or near > self.containers[-1]):
            self.end_from(near)
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        state = self.opened(tag, first)
        if tag not in _VOID:
            self.places[tag].append(len(self.open))
            if tag in _CONTAINERS:
                self.containers.append(len(self.open))
            self.open.append((tag, state))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.places[tag]:
            self.end_from(self.places[tag][-1])

    def silent(self) -> bool:
        return any(self.places[t] for t in _SILENT)


class Page(OpenTags):
    def __init__(self) -> None:
        super().__init__()
        self.count, self.texts, self.links, self.title = Counter(), [], [], ""
        self.words = 0
        self.blocks: list[tuple[int, int]] = []
        self.paragraphs: list[int] = []

    def opened(self, tag: str, attrs: dict[str, str]) -> tuple[int, int]:
        self.count[tag] += 1
        state = (len(self.links), self.words)
        if tag == "a" and "href" in attrs:
            self.links.append(attrs["href"])
        return state

    def closed(self, tag: str, state: tuple[int, int]) -> None:
        if tag in _BLOCKS:
            self.blocks.append((state[0], len(self.links)))
        if tag == "p":
            self.paragraphs.append(self.words - state[1])

    def handle_data(self, data: str) -> None:
        part = data.strip()
        if not part or self.silent():
            return
        if self.places["title"] and not self.title:
            self.title = part
        self.texts.append(part)
        if self.places["p"]:
            self.words += len(_TOKEN.findall(part.lower()))

    def row(self) -> dict:
        self.end_from(0)
        c = self.count
        return {
            "text": " ".join(self.texts), "title": self.title, "headings": [c[f"h{i}"] for i in range(1, 7)], "paragraphs": c["p"],
            "lists": c["ul"] + c["ol"], "items": c["li"], "tables": c["table"], "images": c["img"], "links": self.links,
            "bolds": c["strong"] + c["b"], "codes": c["pre"] + c["code"],
            "blocks": [{"start": a, "end": b} for a, b in self.blocks], "paragraph_words": self.paragraphs, "parse_error": None,
        }


_INTS = pa.list_(pa.int32())
PAGE = pa.struct([
    ("text", pa.string()), ("title", pa.string()), ("headings", _INTS), ("paragraphs", pa.int32()), ("lists", pa.int32()), ("items", pa.int32()),
    ("tables", pa.int32()), ("images", pa.int32()), ("links", pa.list_(pa.string())), ("bolds", pa.int32()), ("codes", pa.int32()),
    ("blocks", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("paragraph_words", _INTS), ("parse_error", pa.string()),
])
PAGE_SCHEMA = "struct<text string, title string, headings array<int>, paragraphs int, lists int, items int, tables int, images int, links array<string>, bolds int, codes int, blocks array<struct<start int, end int>>, paragraph_words array<int>, parse_error string>"


def parse(html: str | None) -> dict:
    page = Page()
    page.feed(html or "")
    page.close()
    return page.row()


def _guarded(read: Callable[..., dict], *args) -> dict:
    try:
        return read(*args)
    except Exception as e:  # noqa: BLE001  one bad page must not end the job
        return {"parse_error": f"{type(e).__name__}: {e}"}


def with_struct(rows: DataFrame, inputs: list[Column], read: Callable[..., dict], name: str, kind: pa.DataType, schema: str) -> DataFrame:
    """rows with a struct column that read gives for the inputs, which are strings. The other columns
    pass through the same Arrow batches, so nothing is joined back. An input that read fails on
    gives a struct of nulls but for parse_error."""
    keep = [c for c in rows.columns if c != name]
    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *[x.alias(f"in{i}") for i, x in enumerate(inputs)])
    carried = [f"c{i}" for i in range(len(keep))]
    given = [f"in{i}" for i in range(len(inputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_guarded(read, *[x.as_py() for x in row]) for row in zip(*[batch.column(g) for g in given], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(found, kind)], [*carried, name])

    fields = T.StructType([*plain.select(*carried).schema.fields, T.StructField(name, T.DataType.fromDDL(schema))])
    return plain.mapInArrow(run, fields).toDF(*keep, name)


def with_page(rows: DataFrame, html: Column, name: str = "page") -> DataFrame:
    """Rows with the parsed page in a struct column; whole pages are parsed."""
    return with_struct(rows, [html], parse, name, PAGE, PAGE_SCHEMA)


def capped(html: Column, most_chars: int = 5_000_000) -> Column:
    """The first most_chars characters, the limit that the published features were made with."""
    return F.substring(html, 1, most_chars)


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", most_chars: int | None = None) -> DataFrame:
    """(key, the fields of a parsed page, parse_error)."""
    source = F.col(html) if most_chars is None else capped(F.col(html), most_chars)
    return with_page(pages.select(key, source.alias("_html")), F.col("_html"), "_page").select(key, "_page.*")


def _sum(column: Column) -> Column:
    return F.aggregate(column, F.lit(0), lambda a, b: a + b)


def structure_columns(page: str) -> dict[str, Column]:
    """Element counts of a page struct and the densities derived from them."""
    c = lambda name: F.col(f"{page}.{name}")
    n = F.size(c("paragraph_words"))
    return {
        **{f"heading_h{i}": F.get(c("headings"), F.lit(i - 1)) for i in range(1, 7)},
        "heading_total": _sum(c("headings")),
        "paragraphs": c("paragraphs"),
        "avg_para_words": F.round(_sum(c("paragraph_words")) / F.greatest(n, F.lit(1)), 1),
        "lists": c("lists"),
        "items": c("items"),
        "list_density": F.round(c("items") / F.greatest(c("paragraphs"), F.lit(1)), 3),
        "tables": c("tables"),
        "images": c("images"),
        "link_count": F.size(c("links")),
        "bolds": c("bolds"),
        "codes": c("codes"),
        "has_code": c("codes") > 0,
    }


def structure(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    rows = parsed.select(key, F.struct(*[c for c in parsed.columns if c != key]).alias("_p"))
    return rows.select(key, *[c.alias(n) for n, c in structure_columns("_p").items()])


def answer_structure(page: str) -> dict[str, Column]:
    """Headings, list items and whether there is a table."""
    return {"answer_heading_count": _sum(F.col(f"{page}.headings")), "answer_list_item_count": F.col(f"{page}.items"), "answer_has_table": F.col(f"{page}.tables") > 0}

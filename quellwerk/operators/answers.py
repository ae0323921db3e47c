"""Answer pages of the platforms as records.

What a platform's pages look like is data: ordered selectors for the question, the answer and the
anchors of the sources, and rules for their names. One routine reads any of them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quellwerk.operators.html import _SILENT, _VOID, OpenTags, with_struct


class Node:
    """An element; its children are elements, texts and comments (as 1-tuples)."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def below(self) -> Iterator[Node]:
        """The elements below this one in document order."""
        held = [c for c in reversed(self.children) if isinstance(c, Node)]
        while held:
            node = held.pop()
            yield node
            held.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def texts(self) -> list[str]:
        """The visible texts at and below this element, without white space at their ends."""
        out, held = [], [self]
        while held:
            item = held.pop()
            if isinstance(item, str):
                if item.strip():
                    out.append(item.strip())
            elif isinstance(item, Node) and (item is self or item.tag not in _SILENT):
                held.extend(reversed(item.children))
        return out

    def text(self) -> str:
        return " ".join(self.texts())

    def inner(self, comments: bool = True) -> str:
        """The markup of what is inside."""
        out: list[str] = []
        held: list = list(reversed(self.children))
        while held:
            item = held.pop()
            if isinstance(item, Node):
                attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in item.attrs.items())
                out.append(f"<{item.tag}{attrs}{'/' if item.tag in _VOID else ''}>")
                if item.tag not in _VOID:
                    held.append((item.tag, "end"))
                    held.extend(reversed(item.children))
            elif isinstance(item, str):
                out.append(entities.escape(item, quote=False))
            elif len(item) == 2:
                out.append(f"</{item[0]}>")
            elif comments:
                out.append(f"<!--{item[0]}-->")
        return "".join(out).strip()

    def outer(self) -> str:
        holder = Node("", {}, None)
        holder.children = [self]
        return holder.inner()


class Tree(OpenTags):
    def __init__(self, source: str):
        super().__init__()
        self.root = Node("", {}, None)
        self.at = self.root
        self.feed(source)
        self.close()

    def opened(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def closed(self, tag: str, state: object) -> None:
        self.at = self.at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def handle_comment(self, data: str) -> None:
        self.at.children.append((data,))


#: One condition of a compound selector: .class, [name], [name op "value"].
_CONDITION = re.compile(r"\.((?:\\.|[\w-])+)|\[([\w-]+)(?:([~^]?=)\"([^\"]*)\")?\]")
_COMPOUND = re.compile(r"(?:[\w*-]+)?(?:\.(?:\\.|[\w-])+|\[[^\]]*\])*")


class Selector:
    """Compound selectors joined by the descendant combinator."""

    def __init__(self, source: str):
        self.steps = [self._compound(part) for part in _COMPOUND.findall(source) if part]

    @staticmethod
    def _compound(source: str) -> tuple[str, list[tuple[str, str | None, str]]]:
        tag = re.match(r"[\w*-]*", source)[0]
        tests = []
        for name, attr, op, value in _CONDITION.findall(source):
            tests.append(("class", "~=", re.sub(r"\\(.)", r"\1", name)) if name else (attr, op or None, value))
        return tag, tests

    @staticmethod
    def _holds(node: Node, step) -> bool:
        tag, tests = step
        if tag not in ("", "*", node.tag):
            return False
        for name, op, value in tests:
            own = node.attrs.get(name)
            if own is None or (op == "=" and own != value) or (op == "^=" and not own.startswith(value)) or (op == "~=" and value not in own.split()):
                return False
        return True

    def all(self, root: Node) -> Iterator[Node]:
        """Matches below root in document order. An element hands down how many leading steps its
        ancestors have met, so a page is walked once."""
        last = len(self.steps) - 1
        held = [(c, 0) for c in reversed(root.children) if isinstance(c, Node)]
        while held:
            node, met = held.pop()
            if met == last and self._holds(node, self.steps[last]):
                yield node
            if met < last and self._holds(node, self.steps[met]):
                met += 1
            held.extend((c, met) for c in reversed(node.children) if isinstance(c, Node))

    def first(self, root: Node) -> Node | None:
        return next(self.all(root), None)


def squeezed(text: str) -> str:
    return " ".join(text.split())


def host_name(url: str) -> str:
    return urlsplit(url).netloc.lower().removeprefix("www.") or "unknown"


def _of_hosts(hosts: tuple[str, ...]) -> Callable[[str], bool]:
    def within(url: str) -> bool:
        own = urlsplit(url).netloc.lower()
        return any(own == h or own.endswith("." + h) for h in hosts)

    return within


# --- names of a source -----------------------------------------------------------------------


def label_text(anchor: Node) -> str:
    """The anchor's text without a +N badge."""
    return re.sub(r"\+\d+$", "", squeezed(anchor.text())).strip()


def label_aria(anchor: Node) -> str:
    """What follows the last dash of the aria-label."""
    label = anchor.attrs.get("aria-label", "").replace(". Opens in new tab.", "").strip().rstrip(".")
    return label.rpartition(" - ")[2].strip()


def label_own(anchor: Node) -> str:
    """The first text right inside the anchor that is no address."""
    own = (c.strip() for c in anchor.children if isinstance(c, str))
    return next((c for c in own if c and not c.startswith("http")), "")


# --- questions -------------------------------------------------------------------------------


def _between(text: str, starts: tuple[str, ...], ends: tuple[str, ...]) -> str:
    """What stands between the first start that occurs and the first end after it."""
    for mark in starts:
        _, found, rest = text.partition(mark)
        if found:
            for end in ends:
                rest = rest.partition(end)[0]
            return rest.strip()
    return ""


@dataclass(frozen=True)
class Platform:
    """How a platform's pages are read. Selectors are tried in order; the first that matches counts."""

    answers: tuple[tuple[str, str], ...]  # (selector, part of the match that is the answer)
    sources: tuple[str, ...]
    label: Callable[[Node], str]
    unwanted: Callable[[str], bool]
    scope: str | None = None  # where answers and sources are looked for, if the page has it
    question_nodes: tuple[str, ...] = ()
    question_marks: tuple[str, ...] = ()
    answer_marks: tuple[str, ...] = ()
    question_patterns: tuple[str, ...] = ()
    title_suffix: str | None = None  # the question is the title without this suffix
    headings: tuple[str, ...] = ()
    paired: bool = False  # sources are in a second file
    spans: str | None = None  # names without addresses, if there is no second file
    links: tuple[str, ...] = field(default=("http",))


# --- fixed values: marks and selectors of the platforms' pages ---------------------------------
CHATGPT = Platform(
    scope='[data-turn="assistant"]',
    answers=((".markdown", "inner"), ("p[data-start]", "each")),
    sources=('[data-testid="webpage-citation-pill"] a[href]', "a[href]"),
    label=label_text,
    unwanted=lambda url: ("chatgpt.com/c/" in url and "utm_source=chatgpt.com" not in url) or "/cdn/assets/" in url,
    question_nodes=('[data-turn="user"] [data-message-author-role="user"]', '[data-turn="user"] .whitespace-pre-wrap', '[data-turn="user"]'),
    question_marks=("你说：", "You said:"),
    answer_marks=("ChatGPT 说：", "ChatGPT said:"),
    question_patterns=(
        r"(?:你说：|You said:)\s*(.+?)\s*(?:ChatGPT 说：|ChatGPT said:|data-turn=\"assistant\")",
        r"data-turn=\"user\".{0,5000}?(?:你说：|You said:)\s*(.+?)<",
    ),
)
GOOGLE = Platform(
    answers=(("div.mZJni", "first div"), ("ul.KsbFXc", "parent"), ("li.dF3vjf", "each")),
    sources=("a.NDNGvf[href]",),
    label=label_aria,
    unwanted=_of_hosts(("google.com", "gstatic.com", "googleapis.com")),
    title_suffix=" - Google Search",
)
PERPLEXITY = Platform(
    answers=(('div.prose div[data-renderer="lm"]', "inner"), ("div.prose", "inner")),
    sources=('a.gap-sm[href^="http"]', 'a[href^="http"][rel~="noopener"]'),
    label=label_own,
    unwanted=lambda url: _of_hosts(("perplexity.ai",))(url) or "google.com/s2/favicons" in url,
    title_suffix="",
    headings=(r"h1.group\/query", "h1"),
    paired=True,
    spans="span.citation.inline",
)
# -----------------------------------------------------------------------------------------------

PLATFORMS: dict[str, Platform] = {"chatgpt": CHATGPT, "google": GOOGLE, "perplexity": PERPLEXITY}


def _title(root: Node) -> str:
    node = Selector("title").first(root)
    return squeezed("".join(c for c in node.children if isinstance(c, str))) if node else ""


def question(platform: Platform, source: str, root: Node) -> str:
    """T29, T30."""
    if platform.title_suffix is not None:
        title = _title(root).removesuffix(platform.title_suffix).strip() if platform.title_suffix else _title(root)
        if title or not platform.headings:
            return title
        nodes = (Selector(s).first(root) for s in platform.headings)
        return next((squeezed(n.text()) for n in nodes if n), "")
    for selector in platform.question_nodes:
        node = Selector(selector).first(root)
        found = node and _between(squeezed(node.text()), platform.question_marks, platform.answer_marks)
        if found:
            return found
    for pattern in platform.question_patterns:
        match = re.search(pattern, source, re.S | re.I)
        found = match and squeezed(Tree(match[1]).root.text())
        if found:
            return found
    return ""


def answer(platform: Platform, scope: Node) -> str:
    """The markup of the answer."""
    for selector, part in platform.answers:
        node = Selector(selector).first(scope)
        if not node:
            continue
        if part == "each":
            return "".join(n.outer() for n in Selector(selector).all(scope))
        if part == "parent":
            return node.parent.inner(comments=False)
        if part == "first div":
            inner = next((c for c in node.children if isinstance(c, Node) and c.tag == "div"), None)
            if inner:
                return inner.inner(comments=False)
            continue
        return node.inner()
    return ""


def sources(platform: Platform, scope: Node) -> list[dict[str, str]]:
    """The cited addresses, each once, where it stands first."""
    anchors: list[Node] = []
    for selector in platform.sources:
        anchors = list(Selector(selector).all(scope))
        if anchors:
            break
    found: dict[str, str] = {}
    for anchor in anchors:
        url = anchor.attrs.get("href", "").strip()
        if url.startswith(platform.links) and url not in found and not platform.unwanted(url):
            found[url] = platform.label(anchor) or host_name(url)
    return [{"url": u, "display_name": n} for u, n in found.items()]


def named_spans(platform: Platform, root: Node) -> list[dict[str, str]]:
    """Names of sources whose addresses are not known."""
    names = (label_text(n) for n in Selector(platform.spans).all(root)) if platform.spans else ()
    return [{"url": "", "display_name": n} for n in names if n]


def read_answer(platform: Platform, source: str | None, pair: str | None = None) -> dict:
    root = Tree(source or "").root
    scope = (platform.scope and Selector(platform.scope).first(root)) or root
    if not platform.paired:
        cited = sources(platform, scope)
    else:
        cited = named_spans(platform, root) if pair is None else sources(platform, Tree(pair).root)
    return {"title": _title(root), "question": question(platform, source or "", root), "answer_html": answer(platform, scope), "citations": cited, "parse_error": None}


_CITED = pa.list_(pa.struct([("url", pa.string()), ("display_name", pa.string())]))
_ANSWER = pa.struct([("title", pa.string()), ("question", pa.string()), ("answer_html", pa.string()), ("citations", _CITED), ("parse_error", pa.string())])
_ANSWER_SCHEMA = "struct<title string, question string, answer_html string, citations array<struct<url string, display_name string>>, parse_error string>"


def parse_answers(files: DataFrame, platform: str, spec: Platform | None = None) -> DataFrame:
    """Files (path, html, and for paired platforms pair_path and pair_html) as records
    (source_file, pair_file, platform, title, question, answer_html, citations, parse_error).

    A platform that is not among PLATFORMS is read by the given spec. A page that cannot be read
    gives nulls and the error."""
    spec = spec or PLATFORMS[platform]
    pair = [F.col("pair_html")] if spec.paired else []
    found = with_struct(files, [F.col("html"), *pair], lambda *texts: read_answer(spec, *texts), "_a", _ANSWER, _ANSWER_SCHEMA)
    other = F.coalesce("pair_path", F.lit("")) if "pair_path" in files.columns else F.lit("")
    return found.select(F.col("path").alias("source_file"), other.alias("pair_file"), F.lit(platform).alias("platform"), "_a.*")


def paired_files(files: DataFrame) -> DataFrame:
    """The answer pages (path, html) with the first page of links of their folder."""
    parts = files.select("path", "html", F.regexp_extract("path", "^(.*)/", 1).alias("_dir"), F.regexp_extract("path", r"_([01])_\d{3}_[^/]*$", 1).alias("_no"))
    second = parts.filter("_no = '1'").groupBy("_dir").agg(F.min_by(F.struct("path", "html"), "path").alias("_pair"))
    return parts.filter("_no = '0'").join(second, "_dir", "left").select("path", "html", F.col("_pair.path").alias("pair_path"), F.col("_pair.html").alias("pair_html"))


def dom_domains(links: DataFrame, key: str, url: str, unwanted: list[str]) -> DataFrame:
    """(key, domain): the distinct domains of an answer's links, in order of their names."""
    from quellwerk.functions import text as X

    u = F.lower(F.trim(F.col(url)))
    kept = links.filter(u.startswith("http://") | u.startswith("https://"))
    for part in unwanted:
        kept = kept.filter(~F.contains(F.lower(url), F.lit(part)))
    return kept.select(key, X.search_domain(F.trim(F.col(url))).alias("domain")).filter("domain is not null").distinct()

"""Pages as trees, and selectors on them: parts of pages by descent, order and exclusion, with sections and their steps.

A selector is simple selectors with combinators between them: a space (anywhere inside), > (a child), + (the next
sibling), ~ (a later sibling). A simple one is a tag or *, with .class, #id, [attr], [attr=value], :not(simple) and :first
behind it. A comma separates alternatives. Texts of an element leave out scripts, styles and what a rule excludes inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import page_key
from .pages import cut_kept, unescaped
from .scopes import _EMPTY

#: Tags that an open one ends by beginning again, as HTML lets their ends be left out.
_SELF_CLOSING = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "select", "main", "aside", "td", "th"}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)  # nodes and texts

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def inside(self) -> Iterator[Node]:
        """All elements below, in the page's order."""
        waiting = self.elements()[::-1]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += node.elements()[::-1]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        closes, node = _SELF_CLOSING.get(tag, set()), self.at
        while closes and node.parent and node.tag not in closes and node.tag not in _BOUNDS:
            node = node.parent
        if node.parent and node.tag in closes:
            self.at = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in _EMPTY:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:  # an end without its beginning is left out
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(source: str | None) -> Node:
    """A page's root; an element that is never closed ends with its parent."""
    builder = _Builder()
    builder.feed(cut_kept(source or ""))
    builder.close()
    return builder.root


_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:=\"?([^\]\"]*)\"?)?\]|:not\(([^)]*)\)|(:first)")


@lru_cache(maxsize=1024)
def _simple(text: str):
    """A test of a node."""
    tag = re.match(r"[\w-]+|\*|", text).group()
    tests = [lambda n: n.tag == tag] if tag not in ("", "*") else []
    rest = text[len(tag) :]
    if _PART.sub("", rest):
        raise ValueError(f"selector {text!r}")
    for m in _PART.finditer(rest):
        name, id_, attr, value, other, first = m.groups()
        if name:
            tests.append(lambda n, x=name: x in n.attrs.get("class", "").split())
        elif id_:
            tests.append(lambda n, x=id_: n.attrs.get("id") == x)
        elif attr:
            tests.append(lambda n, a=attr, v=value: a in n.attrs and (v is None or n.attrs[a] == v))
        elif first:
            tests.append(lambda n: n.parent is not None and n.parent.elements()[0] is n)
        else:
            tests.append(lambda n, t=_simple(other): not t(n))
    return lambda n: all(t(n) for t in tests)


@lru_cache(maxsize=1024)
def _steps(selector: str) -> list[list[tuple[str, object]]]:
    """Alternatives, each a list of (combinator, test), the first one's being a descent."""
    out = []
    for one in selector.split(","):
        tokens = re.findall(r"[>+~]|[^\s>+~]+(?:\([^)]*\))?", re.sub(r"\(\s*([^)]*?)\s*\)", r"(\1)", one.strip()))
        steps, how = [], " "
        for t in tokens:
            if t in ">+~":
                how = t
            else:
                steps.append((how, _simple(t)))
                how = " "
        if not steps or how != " ":
            raise ValueError(f"selector {selector!r}")
        out.append(steps)
    return out


def _reached(node: Node, how: str) -> Iterable[Node]:
    if how == " ":
        return node.inside()
    if how == ">":
        return node.elements()
    beside = node.parent.elements() if node.parent else [node]
    later = beside[beside.index(node) + 1 :]
    return later[:1] if how == "+" else later


def select(node: Node, selector: str) -> list[Node]:
    """Elements that a selector finds below a node, each once, in the page's order."""
    hits: set[int] = set()
    for steps in _steps(selector):
        now = [node]
        for how, test in steps:
            now = list({id(n): n for start in now for n in _reached(start, how) if test(n)}.values())
        hits |= {id(n) for n in now}
    return [n for n in node.inside() if id(n) in hits] if hits else []


def text_of(node: Node, without: str = "") -> str:
    """An element's text with single spaces, but for scripts, styles and what is excluded inside it."""
    gone = {id(n) for n in select(node, without)} if without else set()
    parts, waiting = [], [node]
    while waiting:
        n = waiting.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.tag not in ("script", "style") and (n is node or id(n) not in gone):
            waiting += n.children[::-1]
    return " ".join(unescaped("".join(parts), cut=False).split())


@dataclass(frozen=True)
class Family:
    """How a family of pages is read. texts: name -> selector; sections: what holds a section, its heading and its steps, selected inside it; tip: a heading that matches it makes tips; media: selector of elements with src or href; without: excluded inside every text."""

    texts: dict[str, str] = field(default_factory=dict)
    section: str = ""
    heading: str = "h2"
    step: str = "li"
    tip: str = r"(?i)^tips?\b"
    media: str = "img, iframe, video"
    without: str = ""


def read_page(source: str | None, family: Family) -> dict:
    """texts, sections (title, tip, steps), media of one page. Elements without text, steps and sections without any, and media without an address are left out."""
    root = tree(source)
    texts = {name: [t for n in select(root, s) if (t := text_of(n, family.without))] for name, s in family.texts.items()}
    sections = []
    for part in select(root, family.section) if family.section else []:
        heading = next((text_of(h, family.without) for h in select(part, family.heading)), "")
        steps = [t for n in select(part, family.step) if (t := text_of(n, family.without))]
        if steps:
            sections.append({"title": heading, "tip": bool(re.search(family.tip, heading)), "steps": steps})
    media = list(dict.fromkeys(a for n in select(root, family.media) if (a := (n.attrs.get("src") or n.attrs.get("href") or "").strip())))
    return {"texts": texts, "sections": sections, "media": media}


def read_pages(pages: DataFrame, families: dict[str, Family], default: Family, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """(key, host, texts: name -> texts, sections, media): a page's family is its host's, else the default's."""
    host = F.coalesce(F.regexp_extract(page_key(F.col(url)), "^[^/]+", 0), F.lit(""))
    kinds = [pa.map_(pa.string(), pa.list_(pa.string())), pa.list_(pa.struct([("title", pa.string()), ("tip", pa.bool_()), ("steps", pa.list_(pa.string()))])), pa.list_(pa.string())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_page(t, families.get(h, default)) for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            columns = [pa.array([list(f["texts"].items()) for f in found], kinds[0]), *(pa.array([f[c] for f in found], k) for c, k in zip(("sections", "media"), kinds[1:]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], names=[key, "host", "texts", "sections", "media"])

    schema = f"{key} {pages.schema[key].dataType.simpleString()}, host string, texts map<string,array<string>>, sections array<struct<title:string,tip:boolean,steps:array<string>>>, media array<string>"
    return pages.select(key, host.alias("host"), body).mapInArrow(run, schema)

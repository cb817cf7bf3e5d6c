"""Web pages: text, metadata, links and JSON-LD of HTML, sitemaps, reference tables."""

from __future__ import annotations

import html
import html.entities
import json
import re
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import page_key

_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "header", "footer", "title"}
_SILENT = {"script", "style"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0
        self.lang = self.canonical = ""
        self.links: list[str] = []
        self.data: list[str] = []
        self._json = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang") or ""
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "link" and a.get("rel") == "canonical":
            self.canonical = a.get("href") or ""
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self._json = True
            self.data.append("")
        if tag in _SILENT:
            self.silent += 1
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            self._json = False
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self._json:
            self.data[-1] += data
        elif not self.silent:
            self.parts.append(data)


_ENTITY = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def cut_kept(text: str) -> str:
    """A text whose ampersands that begin no whole entity, such as that of a cut-off '&am' or '&amp', are escaped: what resolves entities leaves them as they were."""
    return _ENTITY.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html.entities.html5) else f"&amp;{m[0][1:]}", text)


def unescaped(text: str, times: int = 5, cut: bool = True) -> str:
    """Entities resolved, also those that were escaped more than once. cut: also those without their semicolon."""
    for _ in range(times):
        plain = html.unescape(text if cut else cut_kept(text))
        if plain == text:
            break
        text = plain
    return text


def _read(source: str | None) -> _Page:
    p = _Page()
    p.feed(source or "")
    p.close()
    return p


def _lines(p: _Page) -> str:
    lines = (" ".join(unescaped(x).split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


def page_text(source: str | None) -> str:
    """Lines of visible text, trimmed, without blank ones."""
    return _lines(_read(source))


def chosen(found: list[dict], url: str) -> dict | None:
    """Of a page's objects the one whose address is the page's; else the only one; else none."""
    same = [x for x in found if isinstance(x.get("url"), str) and x["url"].rstrip("/") == (url or "").rstrip("/")]
    return same[0] if len(same) == 1 else found[0] if len(found) == 1 else None


def nodes_of(value, kind: str) -> list[dict]:
    """JSON-LD objects of a type (the last part of its name counts), in lists and graphs too."""
    if isinstance(value, list):
        return [n for v in value for n in nodes_of(v, kind)]
    if not isinstance(value, dict):
        return []
    types = value.get("@type") or []
    types = types if isinstance(types, list) else [types]
    mine = [value] if any(isinstance(t, str) and re.split(r"[/#]", t)[-1] == kind for t in types) else []
    return mine + nodes_of(value.get("@graph") or [], kind)


def resolved(table: list, at: int = 0, depth: int = 40):
    """The value at a place of a table whose containers hold places of the same table; a cycle, or what lies too deep, is null."""
    done: dict[int, object] = {}

    def go(i, open_: frozenset, left: int):
        if not isinstance(i, int) or isinstance(i, bool) or not 0 <= i < len(table) or i in open_ or left < 0:
            return None
        if i not in done:
            v = table[i]
            if isinstance(v, dict):
                v = {k: go(x, open_ | {i}, left - 1) for k, x in v.items()}
            elif isinstance(v, list):
                v = [go(x, open_ | {i}, left - 1) for x in v]
            done[i] = v
        return done[i]

    return go(at, frozenset(), depth)


def parsed_pages(pages: DataFrame, key: str = "page_id", body: str = "html", kind: str = "Recipe", url: str | None = None) -> DataFrame:
    """(key, lang, canonical, n_links, text, data, record): data is the page's JSON-LD of one kind, as a JSON list; record the one of them that is the page's (see chosen), by its address where there is a column of it, else null."""
    named = pages.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for source, address in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                p = _read(source)
                found: list[dict] = []
                for d in p.data:
                    try:
                        found += nodes_of(json.loads(d), kind)
                    except ValueError:
                        pass
                one = chosen(found, address or p.canonical)
                rows.append((p.lang, p.canonical, len(p.links), _lines(p), json.dumps(found, ensure_ascii=False, sort_keys=True), one and json.dumps(one, ensure_ascii=False, sort_keys=True)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([b.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string())], names=[key, "lang", "canonical", "n_links", "text", "data", "record"])

    address = F.col(url) if url else F.lit("")
    return pages.select(key, body, address.alias("_address")).mapInArrow(run, f"{key} {named}, lang string, canonical string, n_links int, text string, data string, record string")


def page_language(body: Column) -> Column:
    return F.lower(F.regexp_extract(body, r"(?i)<html[^>]*\blang=\"([a-zA-Z-]+)\"", 1))


def page_title(body: Column) -> Column:
    return F.regexp_extract(body, r"(?is)<title>(.*?)</title>", 1)


def page_links(body: Column) -> Column:
    """Addresses that a page links to, each once."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?i)<a\s[^>]*href=\"([^\"#]+)"), 1))


def resolved_tables(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, data, error) of JSON texts that are reference tables: their first value with all references followed, as JSON; what is no table has an error."""
    named = rows.schema[key].dataType.simpleString()

    def one(text: str | None) -> tuple[str | None, str]:
        try:
            table = json.loads(text or "")
        except ValueError:
            return None, "no JSON"
        if not isinstance(table, list) or not table:
            return None, "no table"
        return json.dumps(resolved(table), ensure_ascii=False, sort_keys=True), ""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=[key, "data", "error"])

    return rows.select(key, body).mapInArrow(run, f"{key} {named}, data string, error string")


def canonical_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """(from, to): links of pages as page keys, those that begin with a slash under the page's own host; other kinds of address go."""
    links = pages.select(F.col(url).alias("page"), F.explode(page_links(F.col(body))).alias("link"))
    host = F.regexp_extract(F.col("page"), r"^([a-zA-Z]+://[^/?#]+)", 1)
    whole = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("https:"), "link")).when(F.startswith("link", F.lit("/")), F.concat(host, "link")).otherwise(F.col("link"))
    return links.select(page_key(F.col("page")).alias("from"), page_key(whole).alias("to")).filter(F.col("to").isNotNull()).distinct()


def frontier(pages: DataFrame, seen: DataFrame, body: str = "html") -> DataFrame:
    """Links that haven't been seen, each once, with how many pages have them."""
    links = pages.select(F.explode(page_links(F.col(body))).alias("url"))
    return links.groupBy("url").agg(F.count("*").alias("pages")).join(seen.select("url"), "url", "left_anti")


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of a sitemap's entries: of an address the latest time."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.filter("loc is not null").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def read_sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of the sitemaps that an index names."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path)
    return rows.filter("loc is not null").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def traversed_sitemaps(spark: SparkSession, path: str, place: Callable[[str], str], most: int = 100) -> DataFrame:
    """(loc, lastmod) of the entries of a sitemap, or of all those that an index names, indexes of indexes too: each document once, `most` of them at most, else ValueError. place: where a sitemap of an address lies. Documents are few; their entries stay distributed."""
    waiting, seen, found = [path], {path}, None
    while waiting:
        entries, index = read_sitemap(spark, waiting[0]), read_sitemap_index(spark, waiting[0])
        waiting.pop(0)
        found = entries if found is None else found.unionAll(entries)
        for r in index.select("loc").orderBy("loc").limit(most + 1).collect():
            if (other := place(r["loc"].strip())) not in seen:
                if len(seen) >= most:
                    raise ValueError(f"more than {most} sitemaps from {path}")
                seen.add(other)
                waiting.append(other)
    return found.groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def by_page_id(entries: DataFrame, pattern: str) -> DataFrame:
    """(id, loc, lastmod): one for each id that a pattern's group finds in the entries, with the least address and the latest time."""
    found = entries.withColumn("id", F.regexp_extract("loc", pattern, 1)).filter("id <> ''")
    return found.groupBy("id").agg(F.min("loc").alias("loc"), F.max("lastmod").alias("lastmod"))


def crawl_outcome(status: Column, url: Column, landed: Column, identity: Column, expected: Column, usable: Column) -> Column:
    """What a fetched page is: failure (no page), redirect (it landed at another page), alias (it says to be another id's), stub (nothing usable in it), else record."""
    failed = status.isNull() | ~status.between(200, 299)
    moved = ~page_key(F.coalesce(landed, url)).eqNullSafe(page_key(url))
    return F.when(failed, "failure").when(moved, "redirect").when(identity.isNotNull() & (identity != expected), "alias").when(~F.coalesce(usable, F.lit(False)), "stub").otherwise("record")

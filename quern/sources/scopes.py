"""Texts of named parts of pages, and rules of parts by host. A scope is a tag, and a class that the tag must have ('' for any)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import page_key
from .pages import cut_kept, unescaped

Scopes = dict[str, tuple[str, str]]
_EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Scoped(HTMLParser):
    """Texts of the outermost elements of each scope; an element that is never closed ends with the page."""

    def __init__(self, scopes: Scopes) -> None:
        super().__init__(convert_charrefs=True)
        self.scopes = scopes
        self.open: list[tuple[str, list[str]]] = []  # tags that are open, with the scopes that each begins
        self.inside = dict.fromkeys(scopes, 0)
        self.found: dict[str, list[str]] = {name: [] for name in scopes}

    def handle_starttag(self, tag, attrs):
        if tag in _EMPTY:
            return
        classes = (dict(attrs).get("class") or "").split()
        begins = [n for n, (t, c) in self.scopes.items() if t == tag and (not c or c in classes)]
        for n in begins:
            if not self.inside[n]:
                self.found[n].append("")
            self.inside[n] += 1
        self.open.append((tag, begins))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, begins = self.open.pop()
                for n in begins:
                    self.inside[n] -= 1
                if t == tag:
                    break

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.open):
            for n, depth in self.inside.items():
                if depth:
                    self.found[n][-1] += data


def scoped_texts(source: str | None, scopes: Scopes, again: int = 5) -> dict[str, list[str]]:
    """Texts of scopes. Whole entities are resolved, and so often `again` where they were escaped more than once; cut-off ones stay as they are written."""
    p = _Scoped(scopes)
    p.feed(cut_kept(source or ""))
    p.close()
    return {n: [x for x in (" ".join(unescaped(t, again, cut=False).split()) for t in ts) if x] for n, ts in p.found.items()}


def scoped(pages: DataFrame, adapters: dict[str, Scopes], default: Scopes, key: str = "page_id", url: str = "url", body: str = "html", again: int = 5) -> DataFrame:
    """(key, host, and an array of texts for each name of a scope): a page's scopes are those of its host, else the default's; names that its scopes lack are empty."""
    names = sorted({n for s in (default, *adapters.values()) for n in s})
    host = F.coalesce(F.regexp_extract(page_key(F.col(url)), "^[^/]+", 0), F.lit(""))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scoped_texts(t, adapters.get(h, default), again) for h, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            texts = [pa.array([f.get(n, []) for f in found], pa.list_(pa.string())) for n in names]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *texts], names=[key, "host", *names])

    fields = "".join(f", `{n}` array<string>" for n in names)
    return pages.select(key, host.alias("host"), body).mapInArrow(run, f"{key} {kind}, host string{fields}")

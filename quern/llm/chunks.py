"""Encoding whole texts piecewise: a text is cut where no token can cross, and each distinct chunk is encoded once.

Word lists of large corpora are long-tailed, so a bounded memory of chunks answers most lookups. The memory never
changes a result: a chunk that is not in it is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: The characters of Unicode's White_Space property, which \s of the tokenizers' patterns means.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with the one space before it, or white space up to there: no match of the byte-level pattern crosses these.
SPACED = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Letters, then ASCII punctuation without the apostrophe: two matches of the tokenizers' patterns (or one).
PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
_ODD = [*(c for c in WHITE if c not in " \n"), "\0", "  ", " \n", "\n ", "\n\n"]


def spaced_chunks(text: str) -> list[str]:
    """The chunks of a text, in order. Most texts have only lone spaces and line feeds between words: those are cut by replacing alone."""
    if not text:
        return []
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD):
        return SPACED.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def words(text: str) -> list[bytes]:
    """Runs of bytes outside 09-0D and 20."""
    return text.encode().split()


class ChunkMemory:
    """Ids of texts, as little-endian unsigned 32-bit integers. split: a text's chunks; encode: ids of chunks that aren't known yet; limit: chunks kept at most."""

    def __init__(self, split: Callable[[str], list], encode: Callable[[list], list[bytes]], limit: int = 700_000):
        self.split, self.encode, self.limit = split, encode, limit
        self.known: dict = {}

    def _keep(self, fresh: dict) -> None:
        if len(self.known) + len(fresh) > self.limit:
            kept = list(self.known.items())[self.limit // 2 :]  # the younger half
            self.known.clear()
            self.known.update(kept)
        self.known.update(list(fresh.items())[: self.limit // 2])

    def many(self, texts: list[str], bulk: int = 2_000_000) -> list[bytes]:
        """Ids of each text; the unknown chunks of about `bulk` characters are encoded together."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= bulk):
                size += len(texts[end])
                end += 1
            cut = [self.split(t) for t in texts[at:end]]
            found = [list(map(self.known.get, c)) for c in cut]
            new = list(dict.fromkeys(c for chunks, xs in zip(cut, found) if None in xs for c, x in zip(chunks, xs) if x is None))
            fresh: dict = {}
            if new:
                fresh = dict(zip(new, self.encode(new)))
                self._keep(fresh)
            for chunks, xs in zip(cut, found):
                out.append(b"".join([fresh[c] if x is None else x for c, x in zip(chunks, xs)] if None in xs else xs))
            at = end
        return out

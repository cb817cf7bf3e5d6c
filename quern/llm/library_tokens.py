"""Ids by the tokenizers library, chunk by chunk.

A chunk of plain letters and punctuation goes straight to the vocabulary's model, as the tokenizer would pass it on
after splitting; any other chunk goes through the whole tokenizer. Strings of special tokens in a text are ordinary
text.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice

from tokenizers import Tokenizer

from .chunks import PLAIN, spaced_chunks, words

#: As PLAIN, in the bytes of a word: letters, then one run of punctuation.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Chunks(dict):
    """Chunk -> ids, made when first asked for; the older half goes when there are `limit` of them. What most misses need is written out in one function, as words of a long tail are asked for once."""

    def __init__(self, tokenizer: Tokenizer, lower: bool, limit: int):
        super().__init__()
        self.tokenizer, self.lower, self.limit = tokenizer, lower, limit
        self.tokenize = tokenizer.model.tokenize
        self.plain = (_WORD if lower else PLAIN).fullmatch
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {}  # of at most `limit` runs of punctuation

    def __missing__(self, chunk: str | bytes) -> bytes:
        if len(self) >= self.limit:
            for old in list(islice(self, self.limit // 2)):
                del self[old]
        text = chunk.decode() if self.lower else chunk
        if (m := self.plain(text)) is None:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        elif m.end(1) == len(text):
            if self.lower:
                text = text.lower()
            # Of ASCII only the space has another letter.
            letters = text.replace(" ", "Ġ") if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
        else:
            word, marks = m.groups()
            if (end := self.marks.get(marks)) is None:
                end = array("I", [t.id for t in self.tokenize(marks)]).tobytes()
                if len(self.marks) < self.limit:
                    self.marks[marks] = end
            ids = self[word.encode() if self.lower else word] + end
        self[chunk] = ids
        return ids


class LibraryTokens:
    """Texts to ids as little-endian unsigned 32-bit integers. lower: the vocabulary is for lower-cased text without white space."""

    def __init__(self, path: str, lower: bool, limit: int = 900_000):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.split = words if lower else spaced_chunks
        self.chunks = _Chunks(tokenizer, lower, limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.chunks.__getitem__
        return [b"".join(map(known, self.split(t))) for t in texts]


_tokens: dict[tuple[str, bool], LibraryTokens] = {}


def library_tokens(path: str, lower: bool) -> LibraryTokens:
    """One for a Python worker, whatever tasks it runs."""
    if (path, lower) not in _tokens:
        _tokens.clear()
        _tokens[path, lower] = LibraryTokens(path, lower)
    return _tokens[path, lower]

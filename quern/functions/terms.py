"""Many terms at once: one automaton of all of them, run over texts in Arrow batches.

A term is words in key form (search_token); it is found as whole words, the leftmost first and of those the longest, and what
one term took another can't use. Terms name kinds and canonical forms, and a dish may imply ingredients that its text doesn't
name. The automaton is built once and broadcast: its size is the vocabulary's, and a text is read once however many terms
there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import search_token

FOUND = "array<struct<term:string,canonical:string,kind:string,place:int,words:int>>"


@dataclass(frozen=True)
class Vocabulary:
    """terms: term -> (canonical form, kind); stems: those of them that are beginnings of a word; implied: canonical form -> terms that it stands for, too."""

    terms: dict[str, tuple[str, str]]
    stems: frozenset[str] = frozenset()
    implied: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        if unknown := sorted({t for ts in self.implied.values() for t in ts} - self.terms.keys()):
            raise ValueError(f"implied, but no terms: {unknown[:5]}")

    def automaton(self) -> ahocorasick.Automaton:
        """Terms with a space before, and behind unless they are stems."""
        out = ahocorasick.Automaton()
        for term in self.terms:
            if words := " ".join(term.split()):
                out.add_word(f" {words}" if term in self.stems else f" {words} ", term)
        out.make_automaton()
        return out


def spans(automaton: ahocorasick.Automaton, stems: frozenset[str], text: str) -> list[tuple[str, int, int]]:
    """(term, place of its first word, words) in a text of words and single spaces, leftmost longest, none over another."""
    if not text or not len(automaton):
        return []
    spaced = f" {text} "
    hits = [(end + 1 - len(term) - (1 if term in stems else 2), -len(term), term) for end, term in automaton.iter(spaced)]
    out, free = [], -1
    for begin, size, term in sorted(hits):
        end = begin - size  # the space before the next word, or the last letter of a stem
        if begin < free:
            continue
        if term in stems:
            end = spaced.index(" ", end)  # a stem takes its whole word
        out.append((term, spaced.count(" ", 0, begin), 1 + term.count(" ")))
        free = end if term in stems else end + 1
    return out


def found_terms(df: DataFrame, key: str, text: Column, vocabulary: Vocabulary) -> DataFrame:
    """(key, found): the terms of each row's text, in order; of a null or empty text none. An implied term follows the one that implies it, with its place and no words; implications don't chain."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, vocabulary.automaton()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, automaton = shared.value
        kind = pa.list_(pa.struct([("term", pa.string()), ("canonical", pa.string()), ("kind", pa.string()), ("place", pa.int32()), ("words", pa.int32())]))
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                own = []
                for term, place, n in spans(automaton, v.stems, t or ""):
                    canonical, of = v.terms[term]
                    own.append((term, canonical, of, place, n))
                    own += [(other, *v.terms[other], place, 0) for other in v.implied.get(canonical, ())]
                rows.append([dict(zip(("term", "canonical", "kind", "place", "words"), x)) for x in own])
            yield pa.record_batch([b.column(0), pa.array(rows, kind)], names=[key, "found"])

    return df.select(key, search_token(text).alias("text")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, found {FOUND}")

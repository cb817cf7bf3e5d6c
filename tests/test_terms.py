import random
import time

import pytest
from pyspark.sql import functions as F

from quern.functions.terms import Vocabulary, found_terms, spans


def by_hand(terms, stems, text):
    """At each word the longest term that begins there, and then on behind it."""
    words, out, k = text.split(), [], 0
    while k < len(words):
        best = None
        for t in terms:
            ws = t.split()
            own = words[k : k + len(ws)]
            if len(own) == len(ws) and own[:-1] == ws[:-1] and (own[-1].startswith(ws[-1]) if t in stems else own[-1] == ws[-1]):
                best = t if best is None or len(t) > len(best) else best
        if best:
            out.append((best, k, len(best.split())))
        k += len(best.split()) if best else 1
    return out


def test_as_word_by_word():
    draw = random.Random(1)
    words = ["a", "ab", "abc", "b", "bc", "c", "d", "da"]
    for _ in range(400):
        terms = {" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(draw.randint(0, 8))}
        stems = frozenset(t for t in terms if draw.random() < 0.3)
        v = Vocabulary({t: (t, "k") for t in terms}, stems)
        text = " ".join(draw.choices(words, k=draw.randint(0, 25)))
        assert spans(v.automaton(), stems, text) == by_hand(terms, stems, text), (terms, stems, text)


def test_kinds_aliases_and_implied_dishes(spark):
    v = Vocabulary({"milk": ("milk", "dairy"), "coconut milk": ("coconut", "plant"), "feta": ("feta", "cheese"), "greek salad": ("salad", "dish"), "γαλα": ("milk", "dairy"), "tomat": ("tomato", "plant")}, frozenset({"tomat"}), {"salad": ("feta", "tomat")})
    df = spark.createDataFrame([(1, "Coconut MILK, milk!"), (2, "Greek salad; Tomatoes"), (3, "Γάλα"), (4, None), (5, ""), (6, "milky")], "k int, t string")
    got = {r["k"]: [(x["canonical"], x["kind"], x["place"], x["words"]) for x in r["found"]] for r in found_terms(df, "k", F.col("t"), v).collect()}
    assert got == {
        1: [("coconut", "plant", 0, 2), ("milk", "dairy", 2, 1)],
        2: [("salad", "dish", 0, 2), ("feta", "cheese", 0, 0), ("tomato", "plant", 0, 0), ("tomato", "plant", 2, 1)],
        3: [("milk", "dairy", 0, 1)], 4: [], 5: [], 6: [],
    }
    assert [r["found"] for r in found_terms(df, "k", F.col("t"), Vocabulary({})).collect()] == [[]] * 6
    with pytest.raises(ValueError):
        Vocabulary({"a": ("a", "k")}, implied={"a": ("b",)})


def test_a_thousand_terms_cost_little_more_than_ten():
    text = " ".join(f"w{k % 5000}" for k in range(60_000))
    took = []
    for n in (10, 1000):
        automaton = Vocabulary({f"w{k * 5} w{k * 5 + 1}": ("", "") for k in range(n)}).automaton()
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            list(automaton.iter(f" {text} "))
            best = min(best, time.perf_counter() - began)
        took.append(best)
    assert took[1] < 10 * took[0]  # not a hundred times

import random

import numpy as np
import pyarrow as pa
import pytest

from quern.operators import alignment as al


def table_of(a, b):
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
    return d[-1][-1]


def cost(a, b, matches):
    """Of keeping just these: between two of them the longer gap."""
    out, i, j = 0, 0, 0
    for x, y in [*matches, (len(a), len(b))]:
        out += max(x - i, y - j)
        i, j = x + 1, y + 1
    return out


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_as_the_whole_table(letters):
    draw = random.Random(len(letters))
    for _ in range(300):
        a = draw.choices(letters, k=draw.randint(0, 30))
        b = draw.choices(letters, k=draw.randint(0, 30)) if draw.random() < 0.5 else [x for x in a if draw.random() < 0.85]
        d, matches = al.aligned(a, b)
        assert d == table_of(a, b) == cost(a, b, matches)
        assert all(a[i] == b[j] for i, j in matches) and matches == sorted(set(matches)) and [j for _, j in matches] == sorted({j for _, j in matches})


def test_long_sequences_that_hardly_differ():
    a = np.arange(30_000) % 997
    b = np.delete(np.insert(a, 500, [5, 5]), 20_000)
    assert al.distance(a, b) == 3


def test_columns(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, None, ["x"]), (3, [], [])], "k int, l array<string>, r array<string>")
    assert {r["k"]: (r["distance"], [tuple(m) for m in r["matches"]]) for r in al.alignments(df, "k", "l", "r").collect()} == {1: (1, [(1, 0)]), 2: (1, []), 3: (0, [])}


def test_methods_by_headings(spark):
    steps = ["mix", "rest", "bake", "cool serve", "keep dry"]
    good = [("Dough", False, ["mix"]), ("Oven", False, ["bake", "cool", "serve"]), ("Tips", True, ["keep dry"])]
    assert al.method_groups(steps, good) == ([("Dough", ["mix"]), ("Oven", ["rest", "bake", "cool serve"])], ["keep dry"])
    assert al.method_groups(steps, [("Tips", True, ["cool serve"])]) == ([("", ["mix", "rest", "bake"])], ["cool serve", "keep dry"])
    for bad in ([], [("a", False, [])], [("a", False, ["bake"]), ("b", False, ["mix"])], [("a", False, ["mi"])], [("a", False, ["keep dry"]), ("b", False, ["mix"])]):
        assert al.method_groups(steps, bad) is None
    df = spark.createDataFrame([(1, steps, good), (2, steps, [("a", False, ["no"])]), (3, None, None)], "k int, s array<string>, g array<struct<title:string,tip:boolean,steps:array<string>>>")
    got = {r["k"]: r["method"] for r in al.grouped_methods(df, "k", "s", "g").collect()}
    assert got[2] is None and got[3]["sections"] == [] and got[1]["tips"] == ["keep dry"] and [x["title"] for x in got[1]["sections"]] == ["Dough", "Oven"]


def test_many_short_pairs_at_once():
    """Short pairs among a few long ones, null lists and null tokens give what each gives alone, and in far less than a step on arrays for each token of each."""
    import time

    draw = random.Random(4)
    token = lambda: draw.choice(["a", "b", "c", None, "ab"])
    sides = [[None if draw.random() < 0.05 else [token() for _ in range(draw.choice([0, 1, 5, 20, 140 if k < 6 else 3]))] for k in range(200)] for _ in range(2)]
    got, matches = al._aligned_columns(*(pa.array(s, pa.list_(pa.string())).slice(3) for s in sides))
    for a, b, d, found in zip(sides[0][3:], sides[1][3:], got, matches.to_pylist()):
        a, b, pairs = a or [], b or [], [(x["left"], x["right"]) for x in found]
        assert d == table_of(a, b) == cost(a, b, pairs) and pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs)
    names = pa.array([[draw.choice("abcdefgh ") for _ in range(20)] for _ in range(20_000)])
    began = time.process_time()
    al._aligned_columns(names, pa.array(names.to_pylist()[::-1]))
    assert time.process_time() - began < 10

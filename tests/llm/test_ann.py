import numpy as np
import pytest

from quern.llm import ann


def truth(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = x @ np.array(v, np.float64)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def search(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    out = {}
    for r in ann.nearest_neighbours(df, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores(spark):
    x = np.random.default_rng(0).normal(size=(2000, 16)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got, expected = search(spark, rows), truth([(i, x[i]) for i in range(2000)])
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) for q in expected)
    assert hits / 2000 >= 0.9
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(abs(s - float(x[a].astype(float) @ x[q].astype(float))) < 1e-9 for a, s in found)


def test_copies_ties_and_what_takes_no_part(spark):
    good = [(i, [1.0, 0.0] if i < 60 else [0.0, float(i)], 0) for i in range(80)]
    bad = [(100, None, 0), (101, [0.0, 0.0], 0), (102, [None, 1.0], 0), (103, [float("nan"), 1.0], 0), (104, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (120, [1.0], 0)]
    got = search(spark, good + bad + good[:2], probed=10**6)
    assert got == {q: [(a, s) for a, s in v] for q, v in truth([(i, v) for i, v, _ in good]).items()}


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 0)], [(0, None, 0)]])
def test_few_rows(spark, rows):
    assert search(spark, rows) == {}


def test_fewer_candidates_than_asked(spark):
    assert search(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (3, [2.0, 0.0], 0)], probed=10**6) == {0: [(3, 2.0), (1, 0.5)]}


def recall(got, expected):
    return sum(len({a for a, _ in got[q]} & {a for a, _ in expected[q]}) for q in expected) / sum(map(len, expected.values()))


def test_clustered_vectors_need_few_lists(spark, monkeypatch):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    x = (centres[draw.integers(0, 40, 3000)] + 0.15 * draw.normal(size=(3000, 16))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    seen = []
    probing = ann.Index.probing
    monkeypatch.setattr(ann.Index, "probing", lambda self, *a, **b: seen.append((probing(self, *a, **b), len(self.coarse))) or seen[-1][0])
    got = search(spark, rows)
    assert recall(got, truth([(i, x[i]) for i in range(3000)])) >= 0.9
    assert seen[0][0] < seen[0][1] / 2


@pytest.mark.parametrize("kind", ["double", "int"])
def test_other_number_types_are_exact(spark, kind):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 8)) if kind == "double" else draw.integers(-9, 9, (300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>").repartition(3)
    want = truth([(i, x[i].astype(float)) for i in range(300) if np.any(x[i])])
    got = {}
    for r in ann.nearest_neighbours(df, probed=10**6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}
    assert all(abs(s - t) < 1e-12 * max(1, abs(t)) for q in want for (_, s), (_, t) in zip(got[q], want[q]))


def test_lists_in_parts(spark):
    first, blocks = ann.parts_of(np.array([3, 4, 25, 0, 9, 2]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and blocks.tolist() == [1, 1, 3, 1, 1, 1]
    x = np.random.default_rng(3).normal(size=(600, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    assert search(spark, rows, part=50, probed=10**6) == search(spark, rows, probed=10**6)

import random
import zlib

import numpy as np

from quern.llm import quality


def labelled(n=400):
    draw = random.Random(0)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(5, 200))]
        bad = i % 6 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 12 else [words[0]] * 50
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs.repartition(3), known).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in got)
    assert np.mean([got[i]["predicted"] == (i % 6 != 0) for i in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs.coalesce(1), known).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    flipped = known.withColumn("quality", (known["doc_id"] % 5 * 0 + known["quality"]).cast("int"))
    assert quality.kept_by_quality(docs, flipped).columns == docs.columns


def test_ranking_puts_good_first():
    rows, labels = labelled(200)
    x, y = np.array([quality.text_features(t) for _, t in rows]), np.array([q for _, q, _ in labels])
    s = quality.fit(x, y).scores(x)
    assert np.mean(s[y == 1][:, None] > s[y == 0]) > 0.98


def test_the_fit_is_the_least_of_the_loss():
    """Against plain gradient descent from another start, and its gradient written out again."""
    draw = np.random.default_rng(3)
    z = draw.normal(size=(80, 6))
    better, worse = draw.integers(0, 40, 300), draw.integers(40, 80, 300)
    ridge = np.full(6, 0.02)
    d = z[better] - z[worse]

    def gradient(w):
        return -(d / (1 + np.exp(d @ w))[:, None]).mean(0) + ridge * w

    w = draw.normal(size=6)
    for _ in range(20_000):
        w -= 0.1 * gradient(w)
    found = quality.minimised(z, better, worse, ridge, block=70)
    assert np.abs(gradient(found)).max() < 1e-8 and np.abs(found - w).max() < 1e-6


def test_scores_do_not_depend_on_the_rows_beside():
    rows, labels = labelled(200)
    x = np.array([quality.text_features(t) for _, t in rows])
    ranking = quality.fit(x, np.array([q for _, q, _ in labels]))
    whole = ranking.scores(x)
    for n in (1, 3, 7, 64):
        assert (np.concatenate([ranking.scores(x[k : k + n]) for k in range(0, len(x), n)]) == whole).all()


def test_long_texts_count_whole():
    assert np.allclose(quality._runs_of_three(b"abcdefgh" * 100, 16), quality._runs_of_three(b"abcdefgh" * 100))


def test_odd_documents(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (5, 0, 0), (6, 0, 1), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(r["score"] is not None for r in out)
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.kept_by_quality(docs, labels)
    assert kept.columns == docs.columns


def test_rows_that_share_a_labelled_id_are_bounded(spark, monkeypatch):
    rows = [(1, f"text {k} of one id") for k in range(60)] + [(1, "text 0 of one id")] * 20 + [(k, f"other {k}") for k in range(2, 40)]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, label: seen.append(len(x)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    quality.learn(docs.repartition(3), labels, 25)
    quality.learn(docs.filter("doc_id = 1"), labels, 1000)
    assert seen == [25, 60]

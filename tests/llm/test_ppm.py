import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quern.llm import ppm


def brute(rows, order=ppm.ORDER):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    raw = [(i, ppm.END * order + (t or "").encode() + ppm.END) for i, t in rows]
    trie, word, ends = defaultdict(Counter), Counter(), 0
    for (i, t), (_, b) in zip(rows, raw):
        if not held[i]:
            ends += 1
            word.update((t or "").encode().lower().split())
            for p in range(order, len(b)):
                for k in (0, 1, order):
                    trie[b[p - k : p]][b[p]] += 1
    for k in range(order, 2, -1):  # in how many contexts one byte longer
        for context, seen in [x for x in trie.items() if len(x[0]) == k]:
            for s in seen:
                trie[context[1:]][s] += 1
    total, kinds = sum(word.values()) + ends, len(word) + (ends > 0)

    def cost(context, symbol):
        out, gone = 0.0, set()
        while True:
            seen = trie.get(context, {})
            left = {s: n for s, n in seen.items() if s not in gone}
            n = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - ppm.DISCOUNT) / n)
            if left:
                out += math.log10(len(left) * ppm.DISCOUNT / n)
            gone |= set(seen)
            if not context:
                return out - math.log10(max(1, 256 - len(gone)))
            context = context[1:]

    out = []
    for (i, t), (_, b) in zip(rows, raw):
        words = (t or "").encode().lower().split()
        base = sum(math.log10((word[w] + 1) / (total + kinds + 1)) for w in words) + math.log10((ends + 1) / (total + kinds + 1))
        score = sum(cost(b[p - order : p], b[p]) for p in range(order, len(b)))
        out.append((i, held[i], len(words) + 1, sum(word[w] > 0 for w in words) + (ends > 0), total, base, score))
    return out, cost


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *(round(x, 6) for x in r[0:] if x is not None)))


def check(df, **limits):
    want, cost = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    got = [tuple(r) for r in ppm.ppm_scores(df, limits=ppm.Limits(**limits)).collect()]
    assert len(got) == len(want)
    for a, b in zip(in_order(got), in_order(want)):
        assert a[:5] == b[:5]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:])), (a, b)
    return cost


def random_rows(seed, n=60):
    draw = random.Random(seed)
    syllables = ["ab", "ra", "ka", "do", "É", "x.", "Y!", "\n"]
    return [(i, " ".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(draw.randint(0, 30)))) for i in range(n)]


def test_scores_and_that_they_are_probabilities(spark):
    df = spark.createDataFrame(random_rows(2), "doc_id long, text string").repartition(3)
    cost = check(df)
    for context in (b"", b"a", b"ra", b"never", b"a ab", b"ab ra"):
        assert math.isclose(sum(10 ** cost(context, s) for s in range(256)), 1, rel_tol=1e-9)
    check(df, chunk=300, slice=64, buckets=3)  # many chunks, texts in slices


def test_contexts_cross_words(spark):
    rows = [(i, "north wind south rain " * 5) for i in range(40)]
    held = next(i for i in range(100, 200) if ppm.is_held_out(i))
    other = next(i for i in range(200, 300) if ppm.is_held_out(i))
    rows += [(held, "north wind south rain"), (other, "wind north rain south")]
    got = {r["doc_id"]: r["score"] for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held] > got[other] + 3  # the same words, the order that was learnt


def test_equal_texts_have_equal_scores_whatever_else_a_row_holds(spark):
    text = random_rows(5, 1)[0][1] * 3
    rows = [(i, t, "en") for i, t in random_rows(3)] + [(1000 + i, text, ["en", "de", None][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    assert len({r["score"] for r in ppm.ppm_scores(df).filter("doc_id >= 1000").collect()}) == 1


@pytest.mark.parametrize("size", [3, 5, 64, 1 << 22])
def test_slices_are_the_grams_of_each_text(size):
    texts = [b"", b"abc", b"x" * 11, b"", "zwölf Boxkämpfer".encode()]
    found = [[] for _ in texts]
    for few, g, begins in ppm._slices(texts, 5, size):
        for i, part in zip(few, np.split(g, begins[1:])):
            found[i] += part.tolist()
    for t, g in zip(texts, found):
        raw = ppm.END * 5 + t + ppm.END
        assert g == [int.from_bytes(raw[p : p + 6], "big") for p in range(len(t) + 1)]


def test_odd_documents(docs, none):
    check(docs)
    check(docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text")))
    assert ppm.ppm_scores(none).count() == 0


def test_without_learning_texts(spark):
    held = next(i for i in range(100) if ppm.is_held_out(i))
    r = ppm.ppm_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 2, 0, 0)
    assert math.isclose(r["score"], -3 * math.log10(256))

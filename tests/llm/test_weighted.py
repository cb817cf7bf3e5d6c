import hashlib
import math
import re
import struct
from collections import Counter
from statistics import mean

import pytest
import xxhash

from quern.llm.weighted import SIDE, weighted_fingerprints

N = 16


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def alike(a, b):
    """Generalised Jaccard similarity of word counts."""
    a, b = Counter(words(a)), Counter(words(b))
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def chain(seed, *parts):
    for p in parts:
        seed = xxhash.xxh64_intdigest(p, seed)
    return seed


def sample(text, d, n=N):
    """The consistent weighted sample of one text, term by term."""
    best = None
    for word, w in Counter(words(text)).items():
        term = struct.pack("<Q", chain(42, word.encode()))
        h, g = (chain(42, term, struct.pack("<i", d // SIDE), struct.pack("<i", 2 * (d % SIDE) + k)) for k in (0, 1))
        r = -math.log(((h >> 32) + 0.5) * 2**-32 * ((h & 0xFFFFFFFF) + 0.5) * 2**-32)
        u = [((g >> at & 0x1FFFFF) + 0.5) * 2**-21 for at in (0, 21, 42)]
        c, b = -math.log(u[0] * u[1]), u[2]
        t = math.floor(math.log(w) / r + b)
        value = math.log(c) - r * (t - b + 1)
        if best is None or value < best[0]:
            best = value, (struct.unpack("<Q", term)[0] ^ (t << 16)) & 0xFFFFFFFF
    return 0 if best is None else best[1]


def edited(rows):
    """(text, edited text, next text) of rows in ascending doc_id, none twice."""
    for i, (_, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        q = len(text) // 4
        yield text, text[: len(text) - q] + following[:q], following


@pytest.fixture(scope="module")
def rows():
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda i: " ".join(vocabulary[int((i * 7 + j * j * 3 + j * i) % (40 + 5 * i))] for j in range(40 + 3 * i))
    return [(i, make(i)) for i in range(40)] + [(100, None), (101, ""), (102, " \n "), (103, "é"), (104, "one two\ttwo\n two ü日本"), (105, make(7)), (106, make(7) + " "), (107, "x " * 3000)]


def test_same_as_term_by_term(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "n") for i, t in rows], "doc_id long, text string, row int, next string").repartition(5)
    got = {r["doc_id"]: r for r in weighted_fingerprints(df, N).collect()}
    assert len(got) == len(rows)
    for (i, _), (text, changed, following) in zip(rows, edited(rows)):
        r = got[i]
        prints = [[sample(t, d) for d in range(N)] for t in (text, changed, following)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == ["".join(f"{x:08x}" for x in p) for p in prints[:2]]
        assert [r["near_edited"], r["near_next"]] == [mean(x == y for x, y in zip(prints[0], p)) for p in prints[1:]]
    assert got[7]["fingerprint"] == got[105]["fingerprint"] == got[106]["fingerprint"] and got[100]["fingerprint"] == got[101]["fingerprint"] == got[102]["fingerprint"] == "0" * 8 * N
    assert got[100]["near_next"] == 1.0 and got[102]["near_next"] == 0.0


def test_agreement_is_generalised_jaccard(spark, rows):
    got = {r["doc_id"]: r for r in weighted_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 256).collect()}
    off = []
    for (i, _), (text, changed, following) in zip(rows, edited(rows)):
        off += [got[i]["near_edited"] - alike(text, changed), got[i]["near_next"] - alike(text, following)]
    assert max(map(abs, off)) < 0.12 and abs(mean(off)) < 0.01


def test_repeated_ids_and_few_rows(spark, docs, none):
    assert weighted_fingerprints(none, N).collect() == []
    (only,) = weighted_fingerprints(docs.filter("doc_id = 0"), N).collect()
    text = docs.filter("doc_id = 0").first()["text"]
    assert only["near_next"] == 1.0 and only["edited_sha256"] == hashlib.sha256((text[: len(text) - len(text) // 4] + text[: len(text) // 4]).encode()).hexdigest()
    same = weighted_fingerprints(spark.createDataFrame([(None, "a b c d")] * 30 + [(1, "a b c d")] * 30, "doc_id long, text string"), N).collect()
    assert len(same) == 60 and {(r["near_next"], r["near_edited"]) for r in same} == {(1.0, same[0]["near_edited"])}
    assert weighted_fingerprints(docs.unionAll(docs), N).count() == 2 * docs.count()


def test_no_python_and_one_exchange_of_texts(spark, rows):
    plan = weighted_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), N)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan

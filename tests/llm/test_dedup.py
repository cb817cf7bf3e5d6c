import hashlib
import random
import re

import numpy as np
import xxhash

from quern.llm import components, simhash, substring

from .conftest import TEXTS


def brute_repeats(rows, window=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        new = set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        seen |= new
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    draw = random.Random(seed)
    passages = [[draw.choice("abcdefgh") * draw.randint(1, 3) + str(draw.randint(0, 9)) for _ in range(draw.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 4)):
            words += draw.choice(passages)[draw.randint(0, 5) :] if draw.random() < 0.6 else [str(draw.randint(0, 10**6)) for _ in range(draw.randint(1, 60))]
        rows.append((i, " ".join(words)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_windows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_WORDS", 500)
    for seed in (1, 2):
        rows = corpus(seed)
        assert sorted(map(tuple, substring.substring_dedup(frame(spark, rows)).collect())) == sorted(brute_repeats(rows))


def test_odd_documents(docs, none):
    got = {r["doc_id"]: tuple(r) for r in substring.substring_dedup(docs).collect()}
    assert got == {r[0]: r for r in brute_repeats(TEXTS)}
    assert substring.substring_dedup(none).count() == 0
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[6] == TEXTS[6][1].split(" a b")[0] and text[1] is None and text[0] == TEXTS[0][1]


def test_a_repeated_row_is_one_document(spark):
    t = " ".join(str(k) for k in range(40))
    got = [tuple(r)[:3] for r in substring.substring_dedup(frame(spark, [(1, t), (1, t), (2, t)])).collect()]
    assert sorted(got) == [(1, 40, 0), (1, 40, 0), (2, 40, 40)]


def test_rolling_hash():
    h = np.arange(1, 60, dtype=np.uint64) * np.uint64(7919)
    for width in (1, 2, 7, 10, 20, 59, 60):
        got = substring.rolling(h, width)
        want = [sum(int(x) * pow(int(substring._M), k, 1 << 64) for k, x in enumerate(h[i : i + width])) % (1 << 64) for i in range(len(h) - width + 1)]
        assert got.tolist() == want


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=2):
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= radius and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprints():
    for _, t in TEXTS:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def near_values(seed, n):
    draw = random.Random(seed)
    base = [draw.getrandbits(64) for _ in range(8)]
    out = {0, 1, (1 << 64) - 1}
    while len(out) < n:
        v = draw.choice(base)
        for _ in range(draw.randint(0, 6)):
            v ^= 1 << draw.randrange(64)
        out.add(v)
    return sorted(out)


def test_groups_by_bit_planes():
    values = near_values(5, 300)
    u, v = simhash.group_links([np.array(values, np.uint64)])
    got = dict(zip(u.tolist(), v.tolist()))
    assert {x: got.get(x, x) for x in values} == brute_components(values)


def test_links_connect_all_that_is_near_also_when_groups_split(spark):
    values = near_values(6, 250)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    want = brute_components(values)
    for small in (2048, 4):
        links = simhash.links(df, small)
        roots = {r["node"] % 2**64: r["root"] % 2**64 for r in components.components(links).collect()}
        group = {}
        for v in values:
            group.setdefault(roots.get(v, v), set()).add(want[v])
        assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(want.values()))


def test_components_of_long_chains(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(chain).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100}
    assert components.components(chain.limit(0)).count() == 0


def test_near_duplicates(docs, none):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fp = {i: slow_fingerprint(t) for i, t in TEXTS}
    label = brute_components(sorted(set(fp.values())))
    least = {}
    for i, v in fp.items():
        if i is not None:
            least[label[v]] = min(least.get(label[v], i), i)
    assert got == {i: (f"{v:016x}", least.get(label[v])) for i, v in fp.items()}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, c in got.values()}, key=str)


def test_rows_without_or_with_a_shared_id_stay(spark):
    draw = random.Random(4)
    clean = [" ".join(str(draw.randint(0, 10**6)) for _ in range(30)) for _ in range(9)]
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[2]), (5, clean[3]), (5, clean[4]), (6, clean[4]), (7, clean[5]), (None, clean[5]), (8, clean[6]), (8, clean[6]), (4, clean[6])]
    want = [(None, clean[0]), (None, clean[1]), (None, clean[2]), (5, clean[3]), (5, clean[4]), (7, clean[5]), (4, clean[6])]
    got = [tuple(r) for r in simhash.one_of_each(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

"""Near copies by shingle similarity, against brute force and on planted copies."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import near
from quern.llm.components import components
from quern.llm.common import WordHashes


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(rows):
    """rows of distinct ids: the least id of each component."""
    sets = {i: brute_shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and jaccard(sets[a], sets[b]) >= 0.8:
                    label[a], changed = label[b], True
    return {i for i in sets if label[i] == i}


def planted(seed, originals, n_words=300):
    """Rows of originals (even ids) and one copy each (odd ids) with 0 to 6 words replaced."""
    draw = random.Random(seed)
    word = lambda: str(draw.randint(0, 10**7))
    rows = []
    for k in range(originals):
        words = [word() for _ in range(n_words)]
        copy = list(words)
        for _ in range(k % 7):
            copy[draw.randrange(n_words)] = word()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_planted_copies_of_0_8_and_more_go(spark):
    rows = planted(3, 140)
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    sets = {i: brute_shingles(t) for i, t in rows}
    close = [i for i in sets if i % 2 and jaccard(sets[i], sets[i - 1]) >= 0.8]
    assert len(close) > 100 and min(jaccard(sets[i], sets[i - 1]) for i in close) < 0.87
    assert sum(i not in got for i in close) / len(close) >= 0.99
    assert all(i in got for i in sets if i not in close)


def chain(seed, n, changed):
    draw = random.Random(seed)
    words, rows = [str(draw.randint(0, 10**7)) for _ in range(200)], []
    for i in range(n):  # each a few words from the one before
        words = list(words)
        for _ in range(changed(i)):
            words[draw.randrange(200)] = str(draw.randint(0, 10**7))
        rows.append((i, " ".join(words)))
    return rows


def test_against_brute_force_with_chains(spark):
    rows = chain(8, 150, lambda i: 1 if i % 10 else 30)
    got = {r["doc_id"] for r in near.one_of_each_similar(frame(spark, rows)).collect()}
    assert got == brute_kept(rows)


def test_groups_beyond_the_size_of_a_task_are_cut_into_blocks(spark):
    rows = chain(9, 120, lambda i: 1)
    few = {(r["_row_key"], r["root"]) for r in near.similar_roots(frame(spark, rows)).collect()}
    cut = {(r["_row_key"], r["root"]) for r in near.similar_roots(frame(spark, rows), group=16).collect()}
    assert few == cut and len({root for _, root in few}) == 1


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_odds_of_bands_and_radius(similarity):
    draw = np.random.default_rng(5)
    width, bands = near.band_shape(1 << 14)
    met = within = 0
    for _ in range(300):
        both = draw.integers(0, 1 << 63, int(1000 * similarity), np.uint64)
        sides = [np.unique(np.r_[both, draw.integers(0, 1 << 63, (1000 - len(both)) // 2, np.uint64)]) for _ in range(2)]
        a, b = (near.simhash_bits(x, max(near.COMPARED, width * bands)) for x in sides)
        met += (a != b)[: width * bands].reshape(bands, width).any(axis=1).all() == 0
        within += (a != b)[: near.COMPARED].sum() <= near.radius()
    assert met >= 290 and within >= 296


def test_a_forest_connects_what_the_radius_does():
    draw = np.random.default_rng(7)
    seeds = draw.integers(0, 1 << 63, (6, 4), np.uint64)
    groups = []
    for n in (2, 70, 200):
        g = seeds[draw.integers(0, 6, n)]
        for _ in range(12):  # up to 12 bits changed
            g[np.arange(n), draw.integers(0, 4, n)] ^= np.uint64(1) << draw.integers(0, 64, n, np.uint64)
        groups.append(g)
    i, j = near.forest(groups, [6, 12, 18, 25], items=64)
    flat, group = np.concatenate(groups), np.repeat([0, 1, 2], [2, 70, 200])
    distance = np.unpackbits((flat[:, None] ^ flat[None]).view(np.uint8).reshape(len(flat), len(flat), -1), axis=2).sum(2)
    linked = (distance <= 25) & (group[:, None] == group[None])

    def labels(edges):
        label = np.arange(len(flat))
        for a, b in edges * 3:
            label[label == max(label[a], label[b])] = min(label[a], label[b])
        return label

    assert (linked[i, j]).all()
    assert (labels(list(zip(i, j))) == labels(list(zip(*np.nonzero(linked))))).all()


def test_sets_are_of_words_in_a_row():
    hashes = WordHashes()
    for text in ("a b c d e f", "A  b\tc d E f", "a b", "a", " \n", "", None, "a b c d e a b c d e a b c d e"):
        assert len(near.shingles(text, hashes)) == len(brute_shingles(text))
    assert (near.shingles("A b C d e f", hashes) == near.shingles("a b\nc d e F", hashes)).all()


def test_odd_rows(spark, docs, none):
    kept = near.one_of_each_similar(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 5, 6, None, 8}
    assert near.one_of_each_similar(none).count() == 0
    same = spark.createDataFrame([(None, "one text of its own"), (None, "and another one"), (7, "some third text here"), (7, "not the same at all, a fourth"), (7, "some third text here")], "doc_id long, text string")
    assert near.one_of_each_similar(same).count() == 4


def test_hot_bands_are_dealt_out_before_they_are_gathered(spark):
    """Candidates connect the same nodes whether groups are compared whole, or cut in blocks from buckets that are dealt out."""
    draw = np.random.default_rng(3)
    bands, width = 6, 8
    base = draw.integers(0, 1 << 63, 4, dtype=np.uint64)
    far = draw.integers(0, 1 << 63, 4, dtype=np.uint64)
    rows = []
    for k in range(400):  # two groups of near copies, some a little further off, and unrelated ones, many with one band in common
        fp = (base if k % 3 else far).copy() if k < 300 else draw.integers(0, 1 << 63, 4, dtype=np.uint64)
        for bit in draw.integers(0, 256, int(draw.integers(0, 40)) if k % 7 else 60):
            fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        keys = draw.integers(0, 1 << width, bands).astype(np.int32)
        keys[0] = 5 if k % 10 else keys[0]
        rows.append((k * 11 - 900, bytearray(fp.tobytes()), bytearray(keys.tobytes())))
    nodes = spark.createDataFrame(rows, "node long, fp binary, bands binary").repartition(3)

    def roots(**limits):
        found = components(near.candidates(nodes, width, bands, len(rows), **limits)).collect()
        return sorted((r["node"], r["root"]) for r in found)

    whole = roots()
    assert 200 < len(whole) < 400
    assert roots(group=16) == whole == roots(group=16, bucket_entries=40) == roots(group=100, bucket_entries=20)


def test_parts_of_edges():
    label = near._parts(7, np.array([1, 2, 5]), np.array([2, 3, 6]))
    assert label.tolist() == [0, 1, 1, 1, 4, 5, 5]


def test_links_that_a_forest_leaves_out(spark):
    """A crowd of nodes near each other, few of which are similar: a pair whose ends closer, unconfirmed edges have connected is still a link."""
    draw = np.random.default_rng(11)
    base = draw.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.repeat(base[None], 60, axis=0)
    for fp in fps:  # at most 12 bits between two of them
        for bit in draw.integers(0, 256, 6):
            fp[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    ids = np.arange(60) * 7 - 200
    keys = np.zeros(2, np.int32).tobytes()
    nodes = spark.createDataFrame([(int(i), bytearray(f.tobytes()), bytearray(keys)) for i, f in zip(ids, fps)], "node long, fp binary, bands binary")
    pairs, crowds = near.candidates_and_crowds(nodes, 8, 2, 60)
    pairs = {(r["a"], r["b"]) for r in pairs.collect()}
    every = {(int(a), int(b)) for a in ids for b in ids if a > b}
    assert len(pairs) < len(every)  # a forest
    for links in (set(), {(int(ids[1]), int(ids[0])), (int(ids[2]), int(ids[0]))}):
        same = {frozenset((int(ids[x]), int(ids[y]))) for x in range(3) for y in range(x)} if links else set()
        roots = spark.createDataFrame([(int(ids[k]), int(ids[0])) for k in range(3)] if links else [], "node long, root long")
        for block in (2048, 16):
            more = {(r["a"], r["b"]) for r in near.left_out(crowds, roots, 30, block).collect()}
            # No pair of one place is missed but those of one component.
            assert more == {p for p in every if frozenset(p) not in same}
    assert near.left_out(crowds, spark.createDataFrame([(int(i), 0) for i in ids], "node long, root long"), 30) is None


def test_links_across_crowds_against_brute_force(spark):
    """Copies of one text whose words are drawn anew at odds that put many pairs on either side of the threshold."""
    draw = random.Random(2)
    base = [str(draw.randint(0, 10**7)) for _ in range(200)]
    rows = []
    for k in range(200):
        words = list(base)
        for at in draw.sample(range(200), 3):
            words[at] = str(draw.randint(0, 10**7))
        rows.append((k, " ".join(words)))
    sets = {i: brute_shingles(t) for i, t in rows}
    links = sum(jaccard(sets[a], sets[b]) >= 0.8 for a in sets for b in range(a))
    assert 0 < links < 2000  # of 19,900 pairs
    got = {r["doc_id"] for r in near.one_of_each_similar(frame(spark, rows)).collect()}
    assert got == brute_kept(rows)


def test_edges_of_a_group_grow_with_its_nodes():
    """Nodes near some of each 64 others only, but of many: a forest connects them, not all pairs."""
    draw = np.random.default_rng(4)
    for n in (512, 2048):
        seeds = draw.integers(0, 1 << 63, (10, 4), np.uint64)
        group = seeds[np.arange(n) % 10]
        i, j, crowd = near.forest_and_crowd([group], near._radii(0.8))
        assert len(i) <= near.FEW * n and len(crowd) == n
        label = near._parts(n, i, j)
        assert all(len(set(label[k::10])) == 1 for k in range(10)) and len(set(label)) == 10


@pytest.mark.parametrize("set_bytes", [near.SET_BYTES, 20_000])
def test_what_a_crowd_leaves_out_is_confirmed_without_its_pairs(spark, set_bytes):
    draw = np.random.default_rng(6)
    n, base = 240, draw.integers(0, 1 << 63, 200, np.uint64)
    sets = []
    for k in range(n):
        s = base.copy()
        changed = draw.choice(200, 10 + k % 17, replace=False)
        s[changed] = draw.integers(0, 1 << 63, len(changed), np.uint64)
        sets.append(np.unique(s))
    sets[5] = sets[5][:90]  # of another size
    ids = np.arange(n) * 7 - 200
    similar = {(a, b) for a in range(n) for b in range(a) if (both := len(np.intersect1d(sets[a], sets[b]))) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)}
    assert 3 * n < len(similar) < n * (n - 1) / 4
    expected = near._parts(n, *np.array(sorted(similar)).T)
    assert len(set(expected)) > 3
    fp = bytearray(32)
    crowds = spark.createDataFrame([(place, int(i), fp) for place in (0, 1) for i in ids[place * 100 :]], "place long, a long, fp binary")
    none = spark.createDataFrame([], "node long, root long")
    found = spark.createDataFrame([(int(i), bytearray(s.tobytes())) for i, s in zip(ids, sets)], "node long, found binary")
    facing = near.nodes_left_out(crowds, none, 30, block=1000 if set_bytes == near.SET_BYTES else 64)
    links = [((r["a"] + 200) // 7, (r["b"] + 200) // 7) for r in near.links_left_out(facing, found, 30, set_bytes=set_bytes).collect()]
    assert set(links) <= similar and (near._parts(n, *np.array(links).T) == expected).all()
    if set_bytes == near.SET_BYTES:
        assert facing.count() < 4 * n and len(links) < 2 * n

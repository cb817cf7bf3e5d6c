import hashlib
import zlib
from itertools import groupby

import pytest

from quern.llm.merkle import height, merkle_manifest

H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return H(*map(framed, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def levels_of(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def path(levels, at, fan):
    for row in levels[:-1]:
        a = at - at % fan
        yield row[a:at], row[at + 1 : a + fan]
        at //= fan


def by_hand(rows, fan):
    key = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    groups = [sorted(g, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for _, g in groupby(sorted(rows, key=key), key)]
    trees = [levels_of([leaf(r, r["text"]) for r in g], fan) for g in groups]
    outer = levels_of([t[-1][0] for t in trees], fan)
    out = []
    for k, (g, t) in enumerate(zip(groups, trees)):
        for i, r in enumerate(g):
            sides = [*path(t, i, fan), *path(outer, k, fan)]
            own = leaf(r, r["text"])
            changed = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            h = leaf(r, r["text"].encode().lower().decode()) if changed else own
            for a, z in sides:
                h = H(*a, h, *z)
            out.append((r["doc_id"], own, t[-1][0], outer[-1][0], H(*(x for a, z in sides for x in (*a, *z))), h, h == outer[-1][0]))
    return out


@pytest.mark.parametrize("fan,levels", [(8, 4), (8, 1), (2, 2)])
def test_same_as_by_hand(spark, docs, fan, levels):
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    rows += [dict(doc_id=100 + i, source="s" if i % 7 else None, lang=[None, "de", "", "ü", "Z", "en"][min(i % 11, 5)], n_chars=None if i % 5 == 0 else i, text=None if i % 13 == 0 else f"Text NUMBER {i} Ü") for i in range(150)]
    rows += [dict(rows[0]), dict(rows[0]), dict(rows[0], text="another"), dict(doc_id=None, source=None, lang=None, n_chars=None, text=None)]
    rows += [dict(doc_id=1, source="s", lang=f"l{i}", n_chars=1, text="A") for i in range(9)]  # groups of one row, more of them than a run
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, source string, lang string, n_chars long, text string").withColumnsRenamed({}).repartition(5)
    got = [tuple(r) for r in merkle_manifest(df, fan, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, by_hand(rows, fan)))
    assert {r[-1] for r in got} == {True, False}


def test_clashing_names_one_row_and_none(docs, none):
    clashing = docs.withColumnsRenamed({"key": "group", "fp": "pos", "places": "leaf", "media": "h", "score": "tie"})
    assert merkle_manifest(clashing).count() == docs.count()
    assert merkle_manifest(none).collect() == []
    (only,) = merkle_manifest(docs.filter("doc_id = 4")).collect()
    assert only["leaf"] == only["subroot"] == only["root"] and only["proof_sha256"] == H() and only["verified"]
    assert merkle_manifest(docs).select("root").distinct().count() == 1


def test_heights():
    assert [height(n) for n in (0, 1, 2, 8, 9, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quern.llm import bpe, packing, token_output
from quern.llm.chunks import SPACED, spaced_chunks
from quern.llm.library_tokens import LibraryTokens

from .conftest import TEXTS

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
OWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts():
    draw = random.Random(3)
    letters = " \n\t'abcIs.,!é 日1²\x1f\r"
    some = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(400)]
    return some + [t or "" for _, t in TEXTS] + ["a" * 3000, "".join(draw.choice("abcd") for _ in range(1500)), "don't I'LL we've"]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


def test_bpe_is_the_librarys():
    codec = bpe.ByteBPE(RANKS, P.PATTERN)
    texts = odd_texts()
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == OWN.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_a_full_memory_changes_nothing():
    small = bpe.ByteBPE(RANKS, P.PATTERN, limit=10)
    assert small.encode(odd_texts()) == bpe.ByteBPE(RANKS, P.PATTERN).encode(odd_texts())


def test_chunks_are_the_text():
    for t in odd_texts():
        assert "".join(spaced_chunks(t)) == t and spaced_chunks(t) == SPACED.findall(t)


@pytest.mark.parametrize("name, lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_library_tokens(name, lower):
    texts, whole = odd_texts(), library(name)
    for t, ids in zip(texts, LibraryTokens(P.path(name), lower).encode(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip_query(docs, none):
    rows = {r["doc_id"]: r for r in bpe.bpe_round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in TEXTS:
        ids = np.array(OWN.encode_ordinary(t or ""), np.uint32)
        assert tuple(rows[i])[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.bpe_round_trip(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def tiles(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at
        at += length
    return at


def test_packing(docs, none):
    rows = packing.packed(docs.repartition(2), P.path("byte_bpe_50k.json")).collect()
    whole = library("byte_bpe_50k.json")
    ids = {i: np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], np.uint32) for i, t in TEXTS}
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(tiles(pieces[i]) == len(x) for i, x in ids.items())
    sizes = [tiles(s) for s in sequences.values()]
    assert all(n <= 1024 and n.bit_count() == 1 for n in sizes)  # no padding
    assert packing.packed(none, P.path("byte_bpe_50k.json")).count() == 0


def test_costs_are_balanced():
    draw = random.Random(1)
    sizes = [draw.randint(1, 600) for _ in range(2000)]
    cost = {}
    for _, _, n, s, _ in packing.balanced(sizes):
        cost[s] = cost.get(s, 0) + n + n * n / 1024
    full = list(cost.values())[: sum(sizes) // 1024]
    assert max(full) < 1.35 * sum(full) / len(full)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_stored_ids(spark, docs, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_output.write_ids(token_output.encoded(docs, P.path("word_bpe_49k.json")), path, encoding)
    got = {r["doc_id"]: tuple(r)[1:] for r in token_output.ids_digest(token_output.read_ids(spark, path)).collect()}
    whole, at = library("word_bpe_49k.json"), 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    import pyarrow.parquet as pq

    files = list((tmp_path / encoding).glob("part-*.parquet"))
    column = pq.ParquetFile(max(files, key=lambda f: f.stat().st_size)).metadata.row_group(0)
    ids = next(column.column(k) for k in range(column.num_columns) if column.column(k).path_in_schema.startswith("ids"))
    assert ids.has_column_index and any(("DICTIONARY" if encoding == "dictionary" else "DELTA") in e for e in ids.encodings)


def test_no_rows(spark, none):
    assert token_output.stored_ids_digest(none, P.path("word_bpe_49k.json")).count() == 0


def scanned_rows(df):
    """Rows that the file scan of a collected frame handed on."""
    node = df._jdf.queryExecution().executedPlan()
    while not node.nodeName().startswith("Scan"):
        node = node.children().apply(0)
    return node.metrics().get("numOutputRows").get().value()


def test_a_selective_read_leaves_pages_and_columns_out(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('word ', id % 100, ' and some more of them') AS text")
    token_output.write_ids(token_output.encoded(docs, P.path("word_bpe_49k.json")), str(tmp_path / "ids"))
    some = token_output.read_range(spark, str(tmp_path / "ids"), 7000, 7009)
    assert [r["doc_id"] for r in some.orderBy("doc_id").collect()] == list(range(7000, 7010))
    plain = token_output.read_range(spark, str(tmp_path / "ids"), 7000, 7009)
    plain.collect()
    assert scanned_rows(plain) <= 2 * token_output.PAGE_ROWS
    counts = token_output.read_range(spark, str(tmp_path / "ids"), 0, 99, ("doc_id", "n_tokens"))
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]

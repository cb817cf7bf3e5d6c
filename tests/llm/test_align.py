import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quern.llm.align import Limits, aligned, tokenizer_alignment
from quern.llm.library_tokens import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MORE = [
    "a  b   c\n\n d \n e\t\tf", "\n", " lead", "trail ", "x\n", "two\nlines", "ends with newline\n\n", "it's <s> </s> <unk> <0x41> <|endoftext|>", "no ▁ here", "über straße été ﬁ ½ x² 日本",
    "word " * 50, "word", "word", "   odd white　space", "a\r\nb", "emoji 👩‍👩‍👧 ok", "1234567890 12.5% $3,000", "--- ... !!! ???",
]


def by_hand(rows):
    """Whole texts by the libraries, every pair of overlapping tokens by their byte ranges."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {letter: byte for byte, letter in _byte_letters().items()}
    own, held = [], Counter()
    for i, text in rows:
        base = (i, 0, 0, 0, 0, "", [])
        if text:
            ea, eb = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ta = [bytes(letters[c] for c in a.id_to_token(k)) for k in ea]
            tb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in eb]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                spans = []
                for ts in (ta, tb):
                    at, own_spans = 0, []
                    for t in ts:
                        own_spans.append((at, at + len(t)))
                        at += len(t)
                    spans.append(own_spans)
                links = [(x, y) for x, (p, q) in zip(ea, spans[0]) for y, (r, s) in zip(eb, spans[1]) if p < s and r < q]
                cuts = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
                groups, last = [], 0
                for c in cuts:
                    inside = [[str(k) for k, (p, q) in zip(e, s) if last <= p and q <= c] for e, s in ((ea, spans[0]), (eb, spans[1]))]
                    groups.append("|".join(map(",".join, inside)))
                    last = c
                base = (i, len(ea), len(eb), len(cuts), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links)
        own.append(base)
        held.update(set(base[-1]))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(*r[:5], sum(held[k] == most[k[0]] for k in r[6]), sum(held[k] for k in r[6]), r[5]) for r in own]


@pytest.mark.parametrize("limits", [Limits(), Limits(block=200, stripes=7, sent=300), Limits(block=1, stripes=64)])
def test_same_as_whole_texts_by_hand(spark, docs, limits):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + k, t) for k, t in enumerate(MORE)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, stripe string").repartition(3)
    got = tokenizer_alignment(df, A, B, limits)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, by_hand(rows)))


def test_texts_of_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = tokenizer_alignment(rows, A, B, Limits(block=50_000)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, by_hand([tuple(r) for r in rows.collect()])))


def test_none_and_only_empty(none, docs):
    assert tokenizer_alignment(none, A, B).collect() == []
    got = tokenizer_alignment(docs.filter("doc_id in (1, 2)"), A, B).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_links_and_groups():
    assert aligned([1, 2], [3], [1, 2], [2]) == ([(0, 0), (1, 0)], [(2, 1)])
    assert aligned([1, 2], [3, 4], [1, 3], [2, 3]) == ([(0, 0), (1, 0), (1, 1)], [(2, 2)])

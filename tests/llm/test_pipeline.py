"""The pipeline's rows against its stages done by brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from quern.llm import quality
from quern.llm.common import table

from .test_dedup import brute_repeats
from .test_near import brute_kept

DATA = "/root/testdata/sf0.001"


def brute_quality(docs, labels):
    """Ids of the documents that a ranking fitted on the labelled ones outside the held-out fold keeps."""
    text = {r["doc_id"]: r["text"] for r in docs}
    rated = sorted((r["quality"], quality.text_features(text[r["doc_id"]]).tolist()) for r in labels if r["doc_id"] in text and zlib.crc32(str(r["doc_id"]).encode()) % 5)
    ranking = quality.fit(np.array([f for _, f in rated]), np.array([q for q, _ in rated]))
    score = ranking.scores(np.array([quality.text_features(t) for t in text.values()]))
    return {i for i, s in zip(text, score) if s >= quality.CUTOFF}


def test_rows(spark):
    documents = table(spark, DATA, "documents")
    rows = documents.collect()
    good = brute_quality(rows, table(spark, DATA, "labels").collect())
    docs = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in good}
    first = brute_kept(list(docs.items()))
    kept = sorted((i, docs[i]) for i in first)
    gone = {i: (n, sha) for i, _, n, sha in brute_repeats(kept)}
    stage = documents
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, DATA)
        assert stage.columns == documents.columns
    got = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert got.keys() == gone.keys()
    for i, (n, sha) in gone.items():
        assert got[i] == docs[i] if n == 0 else hashlib.sha256(got[i].encode()).hexdigest() == sha
    tokens = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    ids = {i: np.array(tokens.encode(t, add_special_tokens=False).ids + [0], np.uint32) for i, t in got.items()}
    held = {i: 0 for i in ids}
    for r in corpus_pipeline.run(spark, DATA).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
        held[r["doc_id"]] += r["length"]
    assert held == {i: len(x) for i, x in ids.items()}


def test_stages_lose_no_rows_without_ids_or_with_shared_ones_and_leave_other_columns_alone(spark):
    names = ["_row_key", "_row_hash", "_repeat_key", "_repeat_hash", "_repeat_places", "_quality_score", "_kept_key", "score", "node", "root"]
    texts = {None: ["the first text that has no id", "a second one without", "and a third of them"], 7: ["two texts share an id", "this is the other of the two"]}
    rows = [(i, t, "en", "s", len(t), *(float(k) for k in range(len(names)))) for i, ts in texts.items() for t in ts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} double" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA) if name != "quality" else quality.kept_by_quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
        assert out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
        assert stage(spark, docs.limit(0), DATA).count() == 0
    packed = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert len(packed) >= len(rows) and corpus_pipeline.packing(spark, docs.limit(0), DATA).count() == 0

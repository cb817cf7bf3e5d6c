"""The queries of this package by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .align import tokenizer_alignment
from .ann import nearest_neighbours
from .bpe import bpe_round_trip
from .common import table
from .media_ogg import ogg_digest
from .merkle import merkle_manifest
from .packing import packed
from .ppm import ppm_scores
from .quality import quality_scores
from .shards import virtual_slot_shards
from .simhash import near_duplicates
from .substring import substring_dedup
from .token_output import stored_ids_digest
from .weighted import weighted_fingerprints


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_digest(table(spark, sf_dir, "documents"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slot_shards(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_ids_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": op1_ogg_media,
    "op2_ppm": op2_ppm,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ivf_pq": op4_ivf_pq,
    "op5_substring": op5_substring,
    "op6_virtual_slots": op6_virtual_slots,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_token_output": op9_token_output,
    "op10_quality": op10_quality,
    "op11_weighted": op11_weighted,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}
#: Every window of 20 words by its text; a word goes where one over it isn't the first of its text.
OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
),
windows AS (
  SELECT doc_id, pos, word,
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS content,
    lead(pos, 19) OVER (PARTITION BY doc_id ORDER BY pos) IS NOT NULL AS whole
  FROM words
),
repeats AS (
  SELECT doc_id, pos, word, whole AND row_number() OVER (PARTITION BY whole, content ORDER BY doc_id, pos) > 1 AS repeated
  FROM windows
),
marked AS (
  SELECT doc_id, pos, word, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM repeats
)
SELECT doc_id, count(pos) AS n_words, count(pos) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN marked USING (doc_id)
GROUP BY doc_id
"""

#: The trees by recursion over levels, the proofs as joins of leaves with the nodes beside their path, the folding by recursion over the path. crc32 goes bit by bit.
OP13_SQL = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text,
    concat_ws('', coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'),
      coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'),
      coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))) % 3 = 0 AS chosen
  FROM documents
),
hashed AS (
  SELECT doc_id, lang, coalesce(chosen, false) AS chosen, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
  FROM fields
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS own FROM hashed),
inner_nodes AS (
  SELECT 0 AS level, lang, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM inner_nodes WHERE n > 1 GROUP BY level, lang, pos // 8
),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM outer_nodes WHERE n > 1 GROUP BY level, pos // 8
),
sides AS (
  SELECT p.own, t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < p.pos // (8 ** t.level)::BIGINT), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > p.pos // (8 ** t.level)::BIGINT), '') AS r
  FROM placed p JOIN inner_nodes t ON t.lang IS NOT DISTINCT FROM p.lang AND t.n > 1 AND t.pos // 8 = (p.pos // (8 ** t.level)::BIGINT) // 8
  GROUP BY p.own, t.level
  UNION ALL
  SELECT p.own, 100 + t.level, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (8 ** t.level)::BIGINT), ''), coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (8 ** t.level)::BIGINT), '')
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN outer_nodes t ON t.n > 1 AND t.pos // 8 = (s.pos // (8 ** t.level)::BIGINT) // 8
  GROUP BY p.own, t.level
),
steps AS (SELECT own, row_number() OVER (PARTITION BY own ORDER BY level) AS k, l, r FROM sides),
proofs AS (SELECT own, sha256(string_agg(l || r, '' ORDER BY k)) AS proof, max(k) AS last FROM steps GROUP BY own),
folds AS (
  SELECT own, 0::BIGINT AS k, CASE WHEN chosen THEN lowered ELSE leaf END AS h FROM placed
  UNION ALL
  SELECT f.own, f.k + 1, sha256(s.l || f.h || s.r) FROM folds f JOIN steps s ON s.own = f.own AND s.k = f.k + 1
)
SELECT doc_id, leaf, s.h AS subroot, o.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = o.h AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN outer_nodes o ON o.n = 1 LEFT JOIN proofs USING (own)
  JOIN folds f ON f.own = p.own AND f.k = coalesce(last, 0)
"""

ORACLE_SQL: dict[str, str] = {"op5_substring": OP5_SQL, "op13_merkle": OP13_SQL}

"""Text functions, parsers, pages and audits over documents, pages, conversations and literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as cl
from ..functions import nested as ne
from ..functions import parse as pa
from ..functions import terms as tm
from ..functions import text as te
from ..operators import audit as au
from ..operators import explore as ex
from ..operators import history as hi
from ..operators import projections as pr
from ..sources import catalog as ca
from ..sources import pages as pg
from ..sources import records as re_
from .registry import query

_TOKEN = "trim(regexp_replace(strip_accents(replace(lower({}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def literals(table, rows: list[tuple], columns: str) -> DataFrame:
    """A small frame of the given values."""
    return table("region").sparkSession.createDataFrame(rows, columns)


@query(f"SELECT doc_id, md5({_TOKEN.format('text')}) AS token_md5 FROM documents")
def normalize_token(table):
    return table("documents").select("doc_id", F.md5(te.search_token(F.col("text")).cast("binary")).alias("token_md5"))


@query("SELECT doc_id, md5(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{L}\\p{N}_]+', ' ', 'g'))) AS token_md5 FROM documents")
def metadata_token(table):
    return table("documents").select("doc_id", F.md5(te.metadata_token(F.col("text")).cast("binary")).alias("token_md5"))



_SOUNDS = "{}"
for _a, _b in te.LATIN_SOUNDS:
    _SOUNDS = f"replace({_SOUNDS}, '{_a}', '{_b}')"
for _c in "abdefghijklmnoprstuvz":
    _SOUNDS = f"regexp_replace({_SOUNDS}, '{_c}+', '{_c}', 'g')"


@query(f"SELECT key, count(*) AS n FROM (SELECT {_SOUNDS.format(_TOKEN.format('p_name'))} AS key FROM part) GROUP BY key")
def title_key_groups(table):
    return table("part").groupBy(te.title_key(F.col("p_name")).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE NOT contains(text, 'All rights') AND NOT contains(text, 'licensed')")
def text_anti(table):
    return table("documents").filter(ex.nowhere_in(F.array("text"), frozenset({"All rights", "licensed"}))).select("doc_id", "lang", "n_chars")


@query("""
WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') AS t FROM conversations),
r AS (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i FROM w)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS place, t[i] AS token, CASE WHEN i > 1 THEN t[i - 1] END AS previous, array_to_string(list_slice(t, greatest(i - 3, 1), i + 3), ' ') AS near FROM r WHERE t[i] <> ''""")
def token_neighbourhood(table):
    rows = table("conversations").select("conv_id", "turn", F.explode(te.neighbourhood(te.words(te.search_token(F.col("text"))))).alias("x"))
    return rows.select("conv_id", "turn", "x.place", "x.token", "x.previous", F.array_join("x.near", " ").alias("near"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations")
def running_step(table):
    return hi.running_steps(table("conversations"), "conv_id", "turn").select("conv_id", "turn", "step")


@query("SELECT p_partkey, round(greatest(0.0, least(10.0, p_retailprice / 997.0 * 10)), 2) AS rating FROM part")
def rating_rescale(table):
    return table("part").select("p_partkey", pa.rating_of_ten(F.col("p_retailprice"), F.lit(997.0)).alias("rating"))


@query("""
SELECT page_id, host || regexp_replace(path, '/+$', '') AS key,
 CASE WHEN starts_with(lower(url), 'https://') AND NOT regexp_matches(lower(authority), '[@:]') THEN 'https://' || host || regexp_replace(path, '/+$', '') END AS canonical,
 CASE WHEN starts_with(lower(url), 'https://') AND NOT regexp_matches(lower(authority), '[@:]') AND (host = 'ththre.example.com' OR host = 'thther.example.org') THEN 'https://' || host || regexp_replace(path, '/+$', '') END AS listed
FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) AS authority, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)?', 1) AS path,
 regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^.*@', ''), ':[0-9]+$', ''), '^www\\.', '') AS host FROM pages)""")
def page_urls(table):
    url = F.col("url")
    return table("pages").select("page_id", pa.page_key(url).alias("key"), pa.canonical_url(url).alias("canonical"), pa.canonical_url(url, ("ththre.example.com", "thther.example.org")).alias("listed"))


@query("""SELECT page_id, lower(regexp_extract(html, '<html[^>]*\\blang="([a-zA-Z-]+)"', 1)) AS lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages""")
def html_meta(table):
    return table("pages").select("page_id", pg.page_language(F.col("html")).alias("lang"), pg.page_title(F.col("html")).alias("title"))


@query()
def html_text(table):
    return pg.parsed_pages(table("pages"), kind="Article").select("page_id", "lang", "n_links", "text")


@query("""
WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href="([^"#]+)', 1))) AS url FROM pages)
SELECT url, count(*) AS pages FROM l WHERE url NOT IN ('/the', '/and') GROUP BY url""")
def link_frontier(table):
    return pg.frontier(table("pages"), literals(table, [("/the",), ("/and",)], "url string"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(table):
    return table("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT doc_id, octet_length(encode('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}')) AS size FROM documents")
def canonical_size(table):
    docs = table("documents").select("n_chars", "lang", "doc_id")
    return docs.select("doc_id", ne.encoded_size(ne.canonical_json(docs)).alias("size"))


@query("SELECT max(octet_length(encode(text))) AS size, min(doc_id) FILTER (octet_length(encode(text)) = (SELECT max(octet_length(encode(text))) FROM documents)) AS doc_id FROM documents")
def size_argmax(table):
    return au.largest(table("documents"), F.octet_length("text"), "doc_id")


@query("SELECT doc_id, 'differs' AS kind FROM documents WHERE n_chars <> octet_length(encode(text))")
def drift_audit(table):
    docs = table("documents").select("doc_id", "n_chars")
    derived = table("documents").select("doc_id", F.octet_length("text").cast("long").alias("n_chars"))
    return au.drift(docs, derived, "doc_id", ["n_chars"]).select("doc_id", "kind")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 4 <> 0 THEN 'missing' WHEN c_custkey % 4 = 0 AND c_custkey % 10 <> 0 THEN 'extra' ELSE 'differs' END AS kind FROM customer WHERE (c_custkey % 10 = 0) <> (c_custkey % 4 = 0) OR (c_custkey % 10 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 9 = 0)")
def drift_full_outer(table):
    c = table("customer").select("c_custkey", "c_nationkey")
    derived = c.filter("c_custkey % 4 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 9 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return au.drift(c.filter("c_custkey % 10 <> 0"), derived, "c_custkey", ["c_nationkey"]).select("c_custkey", "kind")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def source_category_matrix(table):
    return table("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (contains(text, '<')) AS markup, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (regexp_matches(text, '^[0-9]')) AS starts_digit FROM documents GROUP BY lang")
def coverage_metrics(table):
    t = F.col("text")
    return au.coverage(table("documents"), "lang", {"short": F.col("n_chars") < 500, "markup": F.contains(t, F.lit("<")), "starts_digit": t.rlike("^[0-9]")})


@query("SELECT coalesce(lang, '') AS lang, coalesce(CAST(quality AS VARCHAR), '') AS quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (quality), ())")
def eligibility_sets(table):
    rows = table("documents").join(table("labels"), "doc_id")
    out = rows.groupingSets([["lang"], ["quality"], []], "lang", "quality").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"), "n")


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars >= 20000 THEN 'length' END, CASE WHEN NOT regexp_matches(text, '^[[:upper:]]') THEN 'start' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents WHERE n_chars >= 20000 OR NOT regexp_matches(text, '^[[:upper:]]')")
def record_violations(table):
    rules = {"length": F.col("n_chars") < 20000, "start": F.col("text").rlike("^[A-Z]")}
    return au.violations(table("documents"), "doc_id", rules).select("doc_id", F.array_join("violations", ",").alias("broken"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(table):
    return au.duplicates(table("orders"), "o_custkey")


@query("SELECT k, only_in FROM (SELECT k, 'left' AS only_in FROM (SELECT p_size AS k FROM part EXCEPT SELECT c_nationkey FROM customer) UNION ALL SELECT k, 'right' FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT p_size FROM part))")
def set_equality(table):
    return au.set_equality(table("part").select(F.col("p_size").alias("k")), table("customer").select(F.col("c_nationkey").alias("k")))


@query("""
WITH r AS (SELECT n_regionkey AS g, sha256(n_nationkey || '|' || '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation),
six AS (SELECT g, substr(h, 1, 6) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY 1, 2), four AS (SELECT g, substr(k, 1, 4) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM six GROUP BY 1, 2),
two AS (SELECT g, substr(k, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM four GROUP BY 1, 2)
SELECT g, sha256(string_agg(h, '' ORDER BY k)) AS digest FROM two GROUP BY g""")
def catalog_digest(table):
    n = table("nation")
    return au.digest(n.withColumn("g", F.col("n_regionkey")), ["g"], "n_nationkey", ne.canonical_json(n))


@query("SELECT doc_id, version, doc_id % 3 <> 0 OR doc_id % 2 = 1 AS fetch FROM (SELECT doc_id, doc_id % 2 AS version FROM documents)")
def checkpoint_reuse(table):
    found = table("documents").select("doc_id", (F.col("doc_id") % 2).alias("version"))
    known = table("documents").filter("doc_id % 3 = 0").select("doc_id", F.lit(0).cast("long").alias("version"), F.col("lang").alias("payload"))
    return ca.reused(found, known, "doc_id", "version").select("doc_id", "version", "fetch")


@query("SELECT doc_id, false AS active FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def retirement(table):
    return ca.retired(table("labels"), table("documents").filter("lang = 'en'"), "doc_id").select("doc_id", "active")


@query("SELECT doc_id, text FROM documents")
def payload_codec(table):
    return table("documents").select("doc_id", re_.inflated(re_.deflated("text")).alias("text"))


@query("SELECT p_partkey, array_to_string([lower(p_name), lower(p_type)], ' ') AS search FROM part")
def search_text(table):
    return table("part").select("p_partkey", pr.search_text(F.col("p_name"), F.col("p_type"), F.upper("p_name")).alias("search"))


@query("SELECT c_custkey, 'id' AS nutrient, CAST(c_custkey AS VARCHAR) AS amount FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey > 3")
def nutrition_unpivot(table):
    c = table("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey").cast("string")).otherwise(" ").alias("nation"))
    return pr.nutrients(c, "c_custkey", ["id", "nation"])


RULES = cl.ClauseRules(
    kinds={"milk": (("milk", "cream"), ("milk",)), "meat": (("ham",), ("chicken", "beef")), "egg": ((), ("egg", "mayo", "en"))},
    bases={"milk": ("coconut", "oat", "soy", "almond")},
)


@query("SELECT doc_id, 'cooked_' || substr(sha256(doc_id || '|' || lang), 1, 32) AS event FROM documents")
def event_ids(table):
    return table("documents").select("doc_id", pa.event_id("cooked", F.col("doc_id").cast("string"), F.col("lang")).alias("event"))


def all_texts(table) -> DataFrame:
    """(source, id, turn, text) of all documents and conversations."""
    docs = table("documents").select(F.lit("documents").alias("source"), F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    return docs.unionAll(table("conversations").select(F.lit("conversations"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_size * 1440 + p_partkey % 24 * 60 WHEN 2 THEN (p_partkey % 600 + 59) // 60 ELSE p_size * 60 + p_partkey % 60 END AS minutes FROM part""")
def part_durations(table):
    k, size = F.col("p_partkey"), F.col("p_size")
    days, hours = F.concat(F.lit("P"), size, F.lit("DT"), k % 24, F.lit("H")), F.concat(F.lit("pt"), size, F.lit("h"), k % 60, F.lit("m"))
    text = F.when(k % 5 == 0, F.concat(F.lit("P"), k)).when(k % 5 == 1, days).when(k % 5 == 2, F.concat(F.lit("PT"), k % 600, F.lit("S"))).otherwise(hours)
    return table("part").select("p_partkey", pa.iso_minutes(text).alias("minutes"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'x_o-' || o_orderkey ELSE 'x_h_' || sha256('o/' || o_orderkey) END AS id FROM orders")
def order_ids(table):
    k = F.col("o_orderkey")
    native = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("o-"), k)).otherwise(F.concat(F.lit("o/"), k))
    return table("orders").select("o_orderkey", pa.document_id(F.lit("x"), native).alias("id"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[0-9]+$') THEN url WHEN regexp_matches(url, '^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$') THEN 'x_' || url ELSE 'x_h_' || sha256(url) END AS id FROM pages")
def page_ids(table):
    return table("pages").select("page_id", pa.document_id(F.lit("x"), F.col("url")).alias("id"))


ALL_TEXTS = "(SELECT 'documents' AS source, CAST(doc_id AS BIGINT) AS id, CAST(0 AS BIGINT) AS turn, text FROM documents UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations)"
_WAIT = "'(?i)([0-9]+(?:[.,][0-9]+)?)\\s*(days?|ημέρ[εα]ς?|hours?|ώρ[εα]ς?|minutes?|min|λεπτά?)'"


@query(f"""
WITH t AS (SELECT source, id, turn, regexp_extract_all(text, {_WAIT}, 1) AS n, regexp_extract_all(text, {_WAIT}, 2) AS u, regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)?)', 1) AS others FROM {ALL_TEXTS})
SELECT source, id, turn, CAST(ceil(CASE
 WHEN len(n) > 0 THEN list_sum(list_transform(range(1, len(n) + 1), lambda i: CAST(replace(n[i], ',', '.') AS DOUBLE) * CASE WHEN regexp_matches(u[i], '(?i)^(day|ημέρ)') THEN 1440 WHEN regexp_matches(u[i], '(?i)^(hour|ώρ)') THEN 60 ELSE 1 END))
 WHEN len(others) > 0 THEN CAST(replace(others[-1], ',', '.') AS DOUBLE) ELSE 0 END) AS BIGINT) AS minutes FROM t""")
def text_waits(table):
    return all_texts(table).select("source", "id", "turn", pa.wait_minutes(F.col("text")).alias("minutes"))


@query(f"""
WITH d AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_size || ' hours, ' || p_partkey % 60 || ' min' WHEN 1 THEN p_size || '-' || (p_size + 5) || ' minutes' WHEN 2 THEN p_size || ' min or so' ELSE p_size || 'h' END AS text,
 CASE p_partkey % 4 WHEN 0 THEN p_size * 60 + p_partkey % 60 WHEN 1 THEN p_size + 5 WHEN 2 THEN 0 ELSE p_size * 60 END AS minutes FROM part)
SELECT 'part' AS source, k AS id, CAST(0 AS BIGINT) AS turn, CAST(minutes AS BIGINT) AS minutes FROM d
UNION ALL SELECT source, id, turn, CASE WHEN text <> '' AND trim(regexp_replace(text, '(?i)(?:[0-9]+\\s*[-–]\\s*)?[0-9]+\\s*(hours?|h|minutes?|min|m)\\b[\\s,]*', '', 'g')) = '' THEN -1 ELSE 0 END FROM {ALL_TEXTS}""")
def text_strict_minutes(table):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 4 == 0, F.concat(size, F.lit(" hours, "), k % 60, F.lit(" min"))).when(k % 4 == 1, F.concat(size, F.lit("-"), size + 5, F.lit(" minutes")))
    text = text.when(k % 4 == 2, F.concat(size, F.lit(" min or so"))).otherwise(F.concat(size, F.lit("h")))
    made = table("part").select(F.lit("part").alias("source"), k.cast("long").alias("id"), F.lit(0).cast("long").alias("turn"), text.alias("text"))
    return made.unionAll(all_texts(table)).select("source", "id", "turn", pa.strict_minutes(F.col("text")).alias("minutes"))


_GLYPH = "[¼½¾⅓⅔⅛⅜⅝⅞]"
_NUM = "[0-9]+(?:[.,][0-9]+)?"
_AMOUNT = f"(?:[0-9]+\\s*{_GLYPH}|[0-9]+\\s+[0-9]+\\s*/\\s*[0-9]+|[0-9]+\\s*/\\s*[0-9]+|{_NUM}\\s*[-–]\\s*{_NUM}|{_NUM}|{_GLYPH})"
_UNITS = "kg|gr?|ml|lt?|tbsp|tsp|cups?|κιλ[όά]|γρ(?:αμμάρι(?:α|ο)?)?|κ\\.\\s?[σγ]|φλ(?:ιτζάνι(?:α)?)?|λίτρ(?:ο|α)|κουταλ(?:ιά|ιές|άκι|άκια)"


def _measured_sql(rows: str, keys: str) -> str:
    return f"""
WITH c AS (SELECT {keys}, trim(regexp_replace(line_text, '\\s+', ' ', 'g')) AS clean FROM ({rows})),
a AS (SELECT *, regexp_extract(clean, '^{_AMOUNT}') AS amount FROM c),
b AS (SELECT *, ltrim(substr(clean, length(amount) + 1)) AS after FROM a),
d AS (SELECT *, regexp_extract(after, '(?i)^({_UNITS})(?:[^\\p{{L}}\\p{{N}}]|$)', 1) AS u FROM b),
e AS (SELECT *, ltrim(regexp_replace(substr(after, length(u) + 1), '^\\.', '')) AS behind FROM d),
f AS (SELECT *, amount = '' OR after = '' OR regexp_matches(after, '(?i)^[x×]\\s*[0-9]') OR (u <> '' AND behind = '') AS whole FROM e),
g AS (SELECT *, CASE WHEN whole THEN clean WHEN u <> '' THEN behind ELSE after END AS t FROM f),
h AS (SELECT *, instr(t, ',') AS comma FROM g),
i AS (SELECT *, CASE WHEN comma > 0 THEN trim(substr(t, 1, comma - 1)) ELSE '' END AS head, CASE WHEN comma > 0 THEN trim(substr(t, comma + 1)) ELSE '' END AS tail FROM h)
SELECT {keys}, CASE WHEN whole THEN '' ELSE amount END AS quantity, CASE WHEN whole THEN '' ELSE u END AS unit,
 CASE WHEN head <> '' AND tail <> '' THEN head ELSE t END AS title, CASE WHEN head <> '' AND tail <> '' THEN tail ELSE '' END AS info FROM i"""


@query(_measured_sql(f"SELECT source, id, turn, CAST(unnest(range(0, len(l))) AS INTEGER) AS line, unnest(l) AS line_text FROM (SELECT source, id, turn, string_split(text, chr(10)) AS l FROM {ALL_TEXTS})", "source, id, turn, line"))
def text_quantities(table):
    lines = all_texts(table).select("source", "id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.select("source", "id", "turn", "line", pa.measured(F.col("text")).alias("m")).select("source", "id", "turn", "line", "m.*")


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_size || '/4' WHEN 3 THEN p_size || ' ½' ELSE '' END AS quantity,
 CASE p_partkey % 5 WHEN 1 THEN 'cups' WHEN 2 THEN 'γρ' ELSE '' END AS unit,
 CASE p_partkey % 5 WHEN 4 THEN p_size || ' x 400 g ' || p_name ELSE p_name END AS title, CASE WHEN p_partkey % 5 < 4 THEN lower(p_type) ELSE '' END AS info FROM part""")
def part_quantities(table):
    k, size = F.col("p_partkey"), F.col("p_size")
    front = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(size, F.lit(" cups "))).when(k % 5 == 2, F.concat(size, F.lit("/4 γρ. "))).when(k % 5 == 3, F.concat(size, F.lit(" ½ "))).otherwise(F.concat(size, F.lit(" x 400 g ")))
    line = F.concat(front, F.col("p_name"), F.when(k % 5 < 4, F.concat(F.lit(" , "), F.lower("p_type"))).otherwise(""))
    return table("part").select("p_partkey", pa.measured(line).alias("m")).select("p_partkey", "m.*")


@query(f"""
WITH c AS (SELECT source, id, turn, unnest(range(0, len(l))) AS cn, unnest(l) AS clause FROM (SELECT source, id, turn, string_split_regex(text, '(?i)\\s+(?:or|ή)\\s+|/') AS l FROM {ALL_TEXTS})),
k AS (SELECT source, id, turn, cn, i, t[i] AS token, CASE WHEN i > 1 THEN t[i - 1] END AS prev, list_slice(t, greatest(i - 3, 1), i + 3) AS near FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT source, id, turn, cn, list_filter(string_split({_TOKEN.format('clause')}, ' '), lambda x: x <> '') AS t FROM c))),
m AS (SELECT *, CASE WHEN token IN ('milk', 'cream') OR starts_with(token, 'milk') THEN 'milk' WHEN token = 'ham' OR starts_with(token, 'chicken') OR starts_with(token, 'beef') THEN 'meat' WHEN starts_with(token, 'egg') OR starts_with(token, 'mayo') OR starts_with(token, 'en') THEN 'egg' END AS kind,
 coalesce(starts_with(prev, 'without') OR starts_with(prev, 'no'), false) AS negated,
 len(list_filter(near, lambda x: starts_with(x, 'vegan'))) > 0 AS qualified, len(list_filter(near, lambda x: starts_with(x, 'coconut') OR starts_with(x, 'oat') OR starts_with(x, 'soy') OR starts_with(x, 'almond'))) > 0 AS based FROM k),
o AS (SELECT *, coalesce(bool_or(negated) OVER (PARTITION BY source, id, turn, cn, kind), false) AS taken_back FROM m WHERE kind IS NOT NULL)
SELECT source, id, turn, EXISTS (SELECT 1 FROM o WHERE o.source = t.source AND o.id = t.id AND o.turn = t.turn AND NOT (negated OR taken_back OR qualified OR (kind = 'milk' AND based))) AS animal FROM {ALL_TEXTS} t""")
def text_clauses(table):
    return all_texts(table).select("source", "id", "turn", cl.unqualified(F.col("text"), RULES).alias("animal"))


_WORDS = {"half an": 0.5, "half a": 0.5, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "eight": 8, "ten": 10, "twelve": 12, "twenty": 20, "thirty": 30}
_ANY = f"[0-9]+\\s*/\\s*[0-9]+|[0-9]+(?:[.,][0-9]+)?|\\b(?:{'|'.join(_WORDS)})"
_DURATION = f"'(?i)(\\bor\\s+)?({_ANY})\\s*(?:(?:-|–|to)\\s*(?:{_ANY})\\s*)?(days?|hours?|minutes?|min)\\b'"
_NUMBER_OF = "CASE " + " ".join(f"WHEN lower(regexp_replace(n[i], '\\s+', ' ', 'g')) = '{w}' THEN {v}" for w, v in _WORDS.items()) + " WHEN contains(n[i], '/') THEN coalesce(TRY_CAST(trim(string_split(n[i], '/')[1]) AS DOUBLE) / nullif(TRY_CAST(trim(string_split(n[i], '/')[2]) AS DOUBLE), 0), 0) ELSE CAST(replace(n[i], ',', '.') AS DOUBLE) END"


@query(f"""
WITH s AS (SELECT source, id, turn, CAST(id % 90 AS INTEGER) AS total, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))) AS s FROM {ALL_TEXTS}),
d AS (SELECT *, regexp_extract_all(s, {_DURATION}, 1) AS alt, regexp_extract_all(s, {_DURATION}, 2) AS n, regexp_extract_all(s, {_DURATION}, 3) AS u FROM s),
f AS (SELECT source, id, turn FROM d WHERE total > 0 AND regexp_matches(s, '(?i)\\b(?:leave|place|bake|boil|simmer|cook|rest|marinate|soak|chill|freeze|wait)\\b') AND NOT regexp_matches(s, '(?i)\\b(?:if|can|may|optional\\w*|alternatively|ideally|keeps?|store)\\b')
 AND (len(list_filter(range(1, len(n) + 1), lambda i: alt[i] = '' AND {_NUMBER_OF} * CASE WHEN lower(u[i])[1] = 'd' THEN 1440 WHEN lower(u[i])[1] = 'h' THEN 60 ELSE 1 END > total)) > 0 OR (total < 30 AND regexp_matches(s, '(?i)\\b(?:overnight|all night|until the next day)\\b'))))
SELECT source, id, turn, CAST((SELECT count(*) FROM f WHERE f.source = t.source AND f.id = t.id AND f.turn = t.turn) AS INTEGER) AS n FROM {ALL_TEXTS} t""")
def text_timing(table):
    total = (F.col("id") % 90).cast("int")
    return all_texts(table).select("source", "id", "turn", F.size(cl.timing_contradictions(F.array("text"), total)).alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 10 = 0 OR p_size % 4 = 2 THEN 0 WHEN p_size % 4 = 3 THEN CASE WHEN p_size % 10 < 3 THEN 1 ELSE 0 END ELSE CASE WHEN p_partkey % 7 * 60 > p_size % 10 * 10 THEN 1 ELSE 0 END END AS n FROM part""")
def part_timing(table):
    """Steps made from all parts: binding hours, optional ones, and nights, against a total."""
    k, size = F.col("p_partkey"), F.col("p_size")
    first = F.when(size % 4 == 2, F.concat(F.lit("You can leave it for "), k % 7, F.lit(" hours."))).when(size % 4 == 3, "Chill overnight.").otherwise(F.concat(F.lit("Mix. Leave for "), k % 7, F.lit(" hours.")))
    return table("part").select("p_partkey", F.size(cl.timing_contradictions(F.array(first, F.lit("Serve")), (size % 10 * 10).cast("int"))).alias("n"))


_TERMS = ["of", "of the", "and", "in the", "in", "the", "de la", "de", "la", "el", "und", "der", "die", "no", "all rights reserved", "http", "www"]
_FOUND = f"regexp_extract_all('  ' || replace({_TOKEN.format('text')}, ' ', '  ') || '  ', ' ({'|'.join(t.replace(' ', '  ') for t in sorted(_TERMS, key=len, reverse=True))}) ', 1)"


@query(f"SELECT doc_id, CAST(coalesce(len(f), 0) AS INTEGER) AS n, sha256(replace(coalesce(array_to_string(f, ','), ''), '  ', ' ')) AS terms FROM (SELECT doc_id, {_FOUND} AS f FROM documents)")
def many_terms(table):
    """Words and runs of words in whole texts by one automaton, the leftmost and longest first."""
    found = tm.found_terms(table("documents"), "doc_id", F.col("text"), tm.Vocabulary({t: (t, "word") for t in _TERMS}))
    return found.select("doc_id", F.size("found").alias("n"), F.sha2(F.array_join(F.col("found.term"), ","), 256).alias("terms"))

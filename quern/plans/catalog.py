"""Exploring, facets and selection over part as a catalog: title p_name, category p_type, source p_brand, minutes p_size, rating p_retailprice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import ease, minutes_label, quick, stable_head
from ..functions.text import label_key, search_token, title_key
from ..operators import explore as ex
from ..operators import facets as fa
from ..operators import select as se
from .registry import query

MOST = 1e9


def columns(df: DataFrame) -> dict[str, Column]:
    return {"id": F.col("p_partkey"), "category": F.col("p_type"), "source": F.col("p_brand"), "minutes": F.col("p_size"), "rating": F.col("p_retailprice"), "title_key": F.col("title_key")}


def catalog(table) -> DataFrame:
    return table("part").withColumn("title_key", title_key(F.col("p_name")))


SHOWN = ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"]


@query("""
SELECT p_partkey, p_name, p_type, p_size, p_retailprice FROM part
WHERE p_type = 'PROMO' AND p_retailprice > 901.0 AND p_size > 0 AND p_size <= 30 AND contains(p_name, 'ring')
ORDER BY contains(' ' || p_name, ' ring') DESC, p_retailprice DESC, p_name, p_partkey LIMIT 24 OFFSET 3""")
def explore_rank_page(table):
    df = catalog(table)
    q = ex.Criteria(category="PROMO", min_rating=901.0, max_minutes=30, terms=("ring",))
    return ex.explore(df, q, columns(df), 24, 3, MOST).select(*SHOWN)


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(' ' || p_name || ' ', ' ring ') AND contains(' ' || p_name || ' ', ' red ')""")
def title_whole_word(table):
    df = catalog(table)
    return df.filter(ex.predicate(ex.Criteria(terms=("ring", "red"), whole_words=True), columns(df))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'in') AND contains(p_name, 're')")
def title_all_terms(table):
    df = catalog(table)
    return df.filter(ex.predicate(ex.Criteria(terms=("in", "re")), columns(df))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 0 AND p_size < 30 AND p_brand IN ('Brand#1', 'Brand#2') AND p_type NOT IN ('PROMO') AND p_brand NOT IN ('Brand#2')")
def source_and_category_exclusion(table):
    df = catalog(table)
    q = ex.Criteria(quick_only=True, sources=frozenset({"Brand#1", "Brand#2"}), preferences=ex.Preferences(frozenset({"Brand#2"}), frozenset({"PROMO"})))
    return df.filter(ex.predicate(q, columns(df))).select("p_partkey", "p_size")


@query("SELECT count(*) AS n FROM part WHERE p_type = 'SMALL' AND p_retailprice > 950.0 AND p_retailprice <= 1e9 AND p_size > 0 AND p_size <= 40 AND p_partkey <> 17")
def planner_count(table):
    df = catalog(table)
    q = ex.Criteria(category="SMALL", min_rating=950.0, max_minutes=40)
    return df.filter(ex.predicate(q, columns(df), MOST) & (F.col("p_partkey") != 17)).agg(F.count("*").alias("n"))


@query("SELECT name, n FROM (SELECT 'valid' AS name, least(count(*), 100) AS n FROM part WHERE p_size BETWEEN 1 AND 30 UNION ALL SELECT 'rating', 0 UNION ALL SELECT 'minutes', 0 UNION ALL SELECT 'beyond', 0)")
def invalid_criteria(table):
    """How many rows a page has: criteria that aren't valid give none, never all."""
    df = catalog(table)
    asked = {"valid": ex.Criteria(max_minutes=30), "rating": ex.Criteria(min_rating=-1.0), "minutes": ex.Criteria(max_minutes=-5), "beyond": ex.Criteria(min_rating=11.0)}
    pages = [ex.explore(df, q, columns(df), 100).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, q in asked.items()]
    return reduce(DataFrame.unionAll, pages)


@query("""
SELECT k AS p_partkey, band, fast, label FROM (SELECT p_partkey AS k,
 CASE WHEN p_size % 4 = 0 AND p_size % 12 = 0 THEN 'unknown' WHEN p_size % 4 >= 3 OR p_size % 12 >= 10 THEN 'involved' WHEN p_size % 4 <= 1 AND p_size % 12 BETWEEN 1 AND 5 THEN 'easy' ELSE 'moderate' END AS band,
 p_size > 0 AND p_size < 30 AS fast,
 CASE WHEN p_size * 7 <= 0 THEN '' WHEN p_size * 7 < 60 THEN (p_size * 7) || ' min' WHEN p_size * 7 % 60 = 0 THEN (p_size * 7 // 60) || ' h' ELSE (p_size * 7 // 60) || ' h ' || (p_size * 7 % 60) || ' min' END AS label FROM part)""")
def ease_and_labels(table):
    size = F.col("p_size")
    return table("part").select("p_partkey", ease(size % 4, size % 12).alias("band"), quick(size).alias("fast"), minutes_label(size * 7).alias("label"))


@query("""
SELECT part, id, name FROM (SELECT 0 AS part, s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey < 5
 UNION ALL SELECT 1, c_custkey, c_name FROM customer WHERE c_nationkey = 7) ORDER BY part, name, id LIMIT 50 OFFSET 10""")
def own_first_paging(table):
    own = table("supplier").filter("s_nationkey < 5").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    shared = table("customer").filter("c_nationkey = 7").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return ex.own_first(own, shared, ["name", "id"], 50, 10)


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' ORDER BY p_partkey LIMIT 1 OFFSET (SELECT count(*) // 2 FROM part WHERE p_type = 'SMALL')")
def pick_at_place(table):
    small = table("part").filter("p_type = 'SMALL'")
    return se.pick_at(small, small.count() // 2, "p_partkey", few=50).select("p_partkey", "p_name")


_PLACE = "CAST('0x' || substr(sha256('{}'), 1, 15) AS BIGINT)"


@query(f"""
SELECT p_partkey, p_name FROM part WHERE p_type = 'SMALL' ORDER BY p_partkey LIMIT 1
OFFSET (SELECT {_PLACE.format(42)} % count(*) FROM part WHERE p_type = 'SMALL')""")
def seeded_pick(table):
    return se.seeded_pick(table("part").filter("p_type = 'SMALL'"), 42, "p_partkey").select("p_partkey", "p_name")


@query(" UNION ALL ".join(f"""
SELECT {seed} AS seed, side, id FROM (SELECT side, id FROM (SELECT 0 AS side, s_suppkey AS id FROM supplier UNION ALL SELECT 1, c_custkey FROM customer) ORDER BY side, id LIMIT 1
 OFFSET (SELECT {_PLACE.format(seed)} % ((SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer))))""" for seed in range(6)))
def mixed_pick(table):
    own = table("supplier").select(F.lit(0).alias("side"), F.col("s_suppkey").alias("id"))
    shared = table("customer").select(F.lit(1).alias("side"), F.col("c_custkey").alias("id"))
    picks = [se.mixed_pick(own, shared, seed, "id").select(F.lit(seed).alias("seed"), "side", "id") for seed in range(6)]
    return reduce(DataFrame.unionAll, picks)


@query("""
WITH f AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rn, count(*) OVER () AS n FROM part WHERE p_type = 'PROMO')
SELECT p_partkey FROM f WHERE p_partkey NOT IN (SELECT p_partkey FROM f WHERE (rn - (n - 1) + n) % n IN (0, 1)) ORDER BY (rn - (n - 1) + n) % n LIMIT 1""")
def wrapping_pick(table):
    promo = table("part").filter("p_type = 'PROMO'")
    rank = F.struct((-F.col("p_retailprice")).alias("p"), F.col("p_partkey").alias("k"))
    n = promo.count()
    keyed = promo.withColumn("rank", rank)
    ends = [se.pick_at(keyed, k, "rank").first()["p_partkey"] for k in (n - 1, 0)]
    return se.wrapping_pick(promo, n - 1, rank, "p_partkey", ends).select("p_partkey")


@query("""
SELECT p_brand, begins FROM (SELECT DISTINCT p_brand, starts_with(lower(p_brand), 'brand#1') AS begins FROM part WHERE contains(lower(p_brand), '1'))
WHERE begins ORDER BY begins DESC, p_brand LIMIT 5""")
def autocomplete(table):
    brands = table("part").select("p_brand").distinct().withColumn("names", F.array(F.lower("p_brand")))
    return se.autocomplete(brands, "brand#1", "p_brand", "names", 5).select("p_brand", "begins")


@query("""
SELECT key FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS key FROM customer)
ORDER BY CASE WHEN regexp_matches(key, '^[0-9]+$') THEN 0 ELSE 1 END, TRY_CAST(key AS HUGEINT), key""")
def numeric_first_order(table):
    key = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    return table("customer").select(key.alias("key")).orderBy(*se.numeric_first(F.col("key")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (77, 5, 300, 42)")
def lookup_in_order(table):
    return se.by_request(table("customer"), [77, 5, 300, 42, 5, -1], "c_custkey").select("c_custkey", "c_name")


@query("""
SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY part, place) AS r FROM (
 SELECT p_partkey AS id, p_name AS title, 0 AS part, p_partkey AS place FROM part WHERE p_size < 5
 UNION ALL SELECT p_partkey, upper(p_name), 1, p_partkey FROM part WHERE p_size < 9)) WHERE r = 1""")
def union_first_wins(table):
    part = table("part").withColumn("place", F.col("p_partkey"))
    a = part.filter("p_size < 5").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "place")
    b = part.filter("p_size < 9").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("title"), "place")
    return se.first_of([a, b], "id").select("id", "title")


@query("SELECT p_type, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def top_per_category(table):
    return se.top_per_group(table("part"), ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3).select("p_type", "p_partkey", "p_retailprice")


# Facets: the parts' words and brand.


def facet_table(table) -> DataFrame:
    rows = fa.facet_rows(table("part"), "p_partkey", {"word": F.split("p_name", " "), "brand": F.array("p_brand")})
    return rows.withColumn("token", search_token(F.col("label")))


@query("""
SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM (SELECT p_partkey AS k, unnest(string_split(p_name, ' ')) AS t FROM part) f WHERE f.k = p.p_partkey AND f.t IN ('red', 'blue'))""")
def facet_semi(table):
    return fa.having(table("part"), facet_table(table), "p_partkey", "word", ["red", "blue"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), ['red', 'blue', 'ring'])) > 0 AND p_brand IN ('Brand#3', 'Brand#4')")
def facet_multi_and(table):
    return fa.having_all(table("part"), facet_table(table), "p_partkey", {"word": ["red", "blue", "ring"], "brand": ["brand 3", "brand 4"]}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, 're')")
def facet_anti(table):
    return fa.lacking(table("part"), facet_table(table), "p_partkey", "word", "re").select("p_partkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def orders_not_in(table):
    return table("customer").join(table("orders").filter("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT facet, token, min(label) AS label FROM (SELECT 'word' AS facet, unnest(string_split(p_name, ' ')) AS label FROM part UNION ALL SELECT 'brand', p_brand FROM part),
LATERAL (SELECT trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS token) GROUP BY facet, token""")
def facet_vocabulary(table):
    return fa.vocabulary(facet_table(table))


@query("""
SELECT token, arg_min(p_name, p_partkey) AS label FROM (SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS token FROM part) GROUP BY token""")
def first_label_by_token(table):
    rows = table("part").select(F.lit("f").alias("facet"), F.split("p_name", " ")[0].alias("token"), F.col("p_name").alias("label"), "p_partkey")
    return fa.first_labels(rows, "p_partkey").select("token", "label")


@query("SELECT key, CASE WHEN key % 2 = 0 THEN 'n' || key ELSE 'c' || key END AS label, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY key HAVING count(*) > 0")
def merged_options(table):
    c = table("customer").select(F.col("c_nationkey").alias("key"), F.lit(1).alias("place"))
    s = table("supplier").select(F.col("s_nationkey").alias("key"), F.lit(0).alias("place"))
    name = F.when((F.col("place") == 0) & (F.col("key") % 2 == 1), " ").when(F.col("key") % 2 == 0, F.concat(F.lit("n"), F.col("key"))).otherwise(F.concat(F.lit("c"), F.col("key")))
    return fa.merged_options(c.unionAll(s).withColumn("label", name).withColumn("n", F.lit(1)))


@query("""
SELECT o_custkey, max(p) AS label FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n, max(count(*)) OVER (PARTITION BY o_custkey) AS most FROM orders GROUP BY 1, 2) WHERE n = most GROUP BY o_custkey""")
def modal_label_greatest(table):
    return fa.modal_label(table("orders"), "o_custkey", "o_orderpriority").select("o_custkey", "label")


@query("""
SELECT o_custkey, min(p) AS label FROM (SELECT o_custkey, o_orderpriority AS p, count(*) AS n, max(count(*)) OVER (PARTITION BY o_custkey) AS most FROM orders GROUP BY 1, 2) WHERE n = most GROUP BY o_custkey""")
def modal_label_least(table):
    return fa.modal_label(table("orders"), "o_custkey", "o_orderpriority", greatest=False).select("o_custkey", "label")


@query("""
SELECT key, arg_max(label, q * 1000000 - p_partkey) AS label FROM (SELECT p_partkey, lower(p_name) AS key, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS label, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS q FROM part) GROUP BY key""")
def best_variant(table):
    part = table("part").withColumn("label", F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return fa.best_variant(part, label_key(F.col("label")), "label", "p_partkey")


@query("SELECT token, count(DISTINCT w) AS variants, count(*) AS n FROM (SELECT lower(w) AS token, w FROM (SELECT unnest(string_split(CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END, ' ')) AS w FROM part)) GROUP BY token HAVING count(DISTINCT w) > 1")
def variant_collisions(table):
    word = F.explode(F.split(F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")), " "))
    return fa.collisions(table("part").select(word.alias("w")).withColumn("token", search_token(F.col("w"))), "token", "w")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: CASE x WHEN 'red' THEN 'colour' WHEN 'blue' THEN 'colour' ELSE x END))), ',') AS tokens FROM part")
def alias_canonical(table):
    return table("part").select("p_partkey", F.array_join(fa.canonical(F.split("p_name", " "), {"red": "colour", "blue": "colour"}), ",").alias("tokens"))


@query("SELECT p_partkey, round(CAST(CAST('0x' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0, 6) AS key6 FROM part")
def stable_random_key(table):
    return table("part").select("p_partkey", F.round(stable_head(F.col("p_partkey").cast("string")) / 4294967296.0, 6).alias("key6"))

"""Normalizers, personal records and weekly plans over part, orders, customers and events as stand-ins for recipes and their users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import explore as ex
from ..operators import facets as fa
from ..operators import normalize as no
from ..operators import personal as pe
from ..operators import planner as pl
from ..operators import projections as pr
from ..operators import select as se
from ..sources.shared import dealt
from .registry import query


def payloads(table) -> DataFrame:
    """part as JSON payloads: two sections of ingredients, one of steps, times in words and by ISO 8601."""
    k, size = F.col("p_partkey"), F.col("p_size")
    one = lambda title, info="": F.struct(title.alias("title"), size.cast("string").alias("quantity"), F.lit(" cups ").alias("unit"), F.lit(info).alias("info"))
    words = F.split("p_name", " ")
    first = F.struct(F.lit(" first  part ").alias("title"), F.transform(words, lambda w: one(F.concat(F.lit(" "), w))).alias("ingredients"))
    second = F.struct(F.lit("second").alias("title"), F.array(one(F.when(k % 2 == 0, "").otherwise(F.col("p_brand")), "chopped")).alias("ingredients"))
    method = F.array(F.struct(F.lit("m").alias("section"), F.transform(F.sequence(F.lit(0), size % 6), lambda i: F.when(i == 0, " ").otherwise(F.concat(F.lit("step "), i.cast("string")))).alias("steps")))
    return dealt(table("part"), "p_partkey").select("p_partkey", F.to_json(F.struct(
        k.cast("string").alias("id"), F.concat(F.lit("  "), F.col("p_name"), F.lit("\n")).alias("title"), F.lit("EN ").alias("language"), F.when(k % 3 == 0, F.concat(F.lit("http://a.org/"), k)).otherwise(F.concat(F.lit("https://www.A.org/"), k, F.lit("?x=1"))).alias("url"),
        F.array(F.col("p_type"), F.lit(" "), F.col("p_type"), F.col("p_brand")).alias("tags"), F.when(k % 2 == 0, F.concat(F.lit("PT"), size, F.lit("M"))).otherwise(F.concat(size, F.lit(" minutes"))).alias("make_time"),
        F.when(k % 5 == 0, "PT1H").alias("bake_time"), (size / 10).cast("string").alias("average_score"), F.array(first, second).alias("ingredient_sections"), method.alias("method"),
    )).alias("payload"))


@query("""
SELECT p_partkey, p_name AS title, 'en' AS language, CASE WHEN p_partkey % 3 <> 0 THEN 'https://a.org/' || p_partkey END AS url, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || ',' || p_brand END AS tags,
 CAST(p_size AS BIGINT) AS prep, CAST(CASE WHEN p_partkey % 5 = 0 THEN 60 ELSE 0 END AS BIGINT) AS cook, CAST(p_size + CASE WHEN p_partkey % 5 = 0 THEN 60 ELSE 0 END AS BIGINT) AS total,
 CAST(len(string_split(p_name, ' ')) + p_partkey % 2 AS INTEGER) AS ingredients, p_size % 6 AS steps, round(p_size / 10 * 2, 2) AS rating,
 CASE WHEN 1 + p_partkey % 2 <= 1 AND p_size % 6 BETWEEN 1 AND 5 THEN 'easy' ELSE 'moderate' END AS ease, p_size + CASE WHEN p_partkey % 5 = 0 THEN 60 ELSE 0 END < 30 AS quick FROM part""")
def normalized_payloads(table):
    r = no.records_of_payloads(payloads(table), "p_partkey", "payload")
    return r.select("p_partkey", "title", "language", F.col("canonicalUrl").alias("url"), F.array_join("tags", ",").alias("tags"), F.col("prepMinutes").cast("long").alias("prep"), F.col("cookMinutes").cast("long").alias("cook"), F.col("totalMinutes").cast("long").alias("total"),
                    F.col("preparationCount").alias("ingredients"), F.col("stepCount").alias("steps"), F.col("rating10").alias("rating"), "ease", F.col("quickRecipe").alias("quick"))


@query("""
SELECT p_partkey, p_name AS title, CAST(p_size AS BIGINT) AS prep, CAST(greatest(p_size + p_size % 9, CASE WHEN p_partkey % 3 = 0 THEN 45 ELSE 0 END) AS BIGINT) AS total, CASE WHEN p_size % 8 <= 5 THEN round(p_size % 8 / 5.0 * 10, 2) ELSE 0.0 END AS rating,
 CASE WHEN p_size = p_size % 9 THEN 'mix' ELSE 'mix;bake' END AS steps FROM (SELECT * FROM part)""")
def linked_data_records(table):
    k, size = F.col("p_partkey"), F.col("p_size")
    step = F.struct(F.lit("HowToStep").alias("@type"), F.when(size == size % 9, " mix").otherwise("bake").alias("text"))
    data = F.to_json(F.struct(
        F.lit("Recipe").alias("@type"), F.concat(F.col("p_name"), F.lit(" ")).alias("name"), F.concat(F.lit("PT"), size, F.lit("M")).alias("prepTime"), F.concat(F.lit("PT"), size % 9, F.lit("M")).alias("cookTime"), F.when(k % 3 == 0, "PT45M").alias("totalTime"),
        F.struct((size % 8).alias("ratingValue"), F.lit("5").alias("bestRating")).alias("aggregateRating"), F.array(F.struct(F.lit("HowToStep").alias("@type"), F.lit("mix").alias("text")), step).alias("recipeInstructions"),
    ))
    r = no.linked_data(dealt(table("part"), "p_partkey").select("p_partkey", data.alias("data")), "p_partkey", "data")
    return r.select("p_partkey", "title", F.col("prepMinutes").cast("long").alias("prep"), F.col("totalMinutes").cast("long").alias("total"), F.col("rating10").alias("rating"), F.array_join("steps", ";").alias("steps"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'A:mix;B:' || p_type || '>' || p_brand ELSE ':mix>' || p_type || '>' || p_brand END AS sections FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def linked_data_sections(table):
    """Records by language and script, with their pages' sections: a third agrees with its page, a third doesn't, a third has none."""
    k = F.col("p_partkey")
    rows = table("part").select("p_partkey", F.when(k % 5 == 0, "de-AT").otherwise("EN_us").alias("lang"), F.when(k % 7 == 0, "12 34 ab").otherwise(F.col("p_name")).alias("title"), F.array(F.lit("mix"), F.col("p_type"), F.col("p_brand")).alias("steps"))
    group = lambda title, anchor: F.struct(F.lit(title).alias("title"), F.lit(False).alias("tip"), F.array(anchor).alias("steps"))
    pages = table("part").filter("p_partkey % 3 < 2").select("p_partkey", F.array(group("A", F.when(k % 3 == 0, "mix").otherwise("fold")), group("B", F.col("p_brand"))).alias("groups"))
    kept = no.gated(rows, F.col("lang"), F.col("title"), "en", "a-z", "0-9")
    shown = F.array_join(F.transform("sections", lambda s: F.concat(s["title"], F.lit(":"), F.array_join(s["steps"], ">"))), ";")
    return no.with_sections(kept, pages, "p_partkey").select("p_partkey", shown.alias("sections"))


@query("""
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w[i] AS title, CAST(p_size AS VARCHAR) AS quantity, 'cups' AS unit, CASE WHEN i = len(w) AND p_partkey % 2 = 1 THEN 'chopped' ELSE '' END AS info
FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT p_partkey, p_size, string_split(p_name, ' ') || CASE WHEN p_partkey % 2 = 1 THEN [p_brand] ELSE [] END AS w FROM part))""")
def ingredient_drafts(table):
    return no.drafts(no.records_of_payloads(payloads(table), "p_partkey", "payload"), "p_partkey", "ingredientSections")


@query("""
SELECT DISTINCT p_partkey, w AS text FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || ' chopped' FROM part WHERE p_partkey % 2 = 1)""")
def ingredient_text_rows(table):
    return no.ingredient_texts(no.records_of_payloads(payloads(table), "p_partkey", "payload"), "p_partkey", "ingredientSections")


@query(" UNION ALL ".join(f"""
SELECT c_custkey, 'n{i}' AS nutrient, CASE WHEN c_nationkey % {i + 2} > 0 THEN CAST(c_nationkey % {i + 2} AS VARCHAR) ELSE '' END AS amount, CASE WHEN c_custkey % {i + 3} = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS portion, '' AS share, CASE WHEN c_custkey % 7 = {i} THEN 'g' ELSE '' END AS unit
FROM customer WHERE c_nationkey % {i + 2} > 0 OR c_custkey % {i + 3} = 0 OR c_custkey % 7 = {i}""" for i in range(8)))
def nutrition_table(table):
    c = table("customer")
    columns = {}
    for i in range(8):
        columns |= {f"a{i}": F.when(F.col("c_nationkey") % (i + 2) > 0, F.col("c_nationkey") % (i + 2)).cast("string"), f"p{i}": F.when(F.col("c_custkey") % (i + 3) == 0, F.col("c_custkey")).cast("string"), f"s{i}": F.lit(" "), f"u{i}": F.when(F.col("c_custkey") % 7 == i, "g")}
    names = {f"n{i}": {"amount": f"a{i}", "portion": f"p{i}", "share": f"s{i}", "unit": f"u{i}"} for i in range(8)}
    return no.nutrition_rows(c.withColumns(columns), "c_custkey", names)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'energy=' || user_id || ';' ELSE '' END || 'kind=' || event_type AS fields FROM events")
def nutrition_fields(table):
    source = F.create_map(F.lit("type"), "event_type", F.lit("kcal"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(" "), F.lit("other"), F.lit("x"))
    found = F.map_entries(no.renamed_fields(source, {"kcal": "energy", "type": "kind"}))
    return table("events").select("event_id", F.array_join(F.transform(F.array_sort(found), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


GROUPS = {"Ring": ["ring", "ringlet"], "Bolt": ["bolt", "screw", "nut"]}


@query("""
SELECT p_partkey, string_agg(label, ';' ORDER BY token) AS labels FROM (SELECT p_partkey, token, min(label) AS label FROM (SELECT p_partkey, CASE WHEN w = 'ring' THEN 'Ring' WHEN w IN ('bolt', 'screw', 'nut') THEN 'Bolt' ELSE w END AS label, CASE WHEN w IN ('screw', 'nut') THEN 'bolt' ELSE w END AS token
 FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)) GROUP BY 1, 2) GROUP BY 1""")
def canonical_facets(table):
    labels = no.canonical_labels(F.array(F.concat(F.lit(" , "), F.regexp_replace("p_name", " ", ", "))), no.alias_table(GROUPS))
    return table("part").select("p_partkey", F.array_join(labels, ";").alias("labels"))


@query("""
SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN w = 'ring' THEN 'Ring' WHEN w IN ('bolt', 'screw', 'nut') THEN 'Bolt' ELSE w END), lambda a, b: CASE WHEN list_contains(string_split(a, ';'), b) THEN a ELSE a || ';' || b END) AS tags FROM part""")
def canonical_tags(table):
    return table("part").select("p_partkey", F.array_join(no.canonical_tags(F.split("p_name", " "), no.alias_table(GROUPS)), ";").alias("tags"))


@query("SELECT p_partkey FROM part WHERE NOT contains(p_name, 'bolt') AND NOT contains(p_name, 'screw') AND NOT contains(p_name, 'nut')")
def excluded_with_aliases(table):
    """An exclusion of one name of a group is one of all."""
    p = ex.Preferences(excluded_categories=frozenset(), excluded_tokens=no.expanded(frozenset({"screw"}), GROUPS))
    return table("part").filter(ex.preferred(p, {"texts": F.split("p_name", " ")})).select("p_partkey")


@query("""
SELECT p_partkey, CASE WHEN p_type IN ('PROMO') THEN p_type WHEN p_brand = 'Brand#1' AND p_size % 3 = 0 THEN 'street_food' WHEN p_type = 'SMALL' THEN 'other' ELSE p_type END AS category FROM part""")
def repaired_categories(table):
    c = F.when(F.col("p_type") == "SMALL", "street_food").otherwise(F.col("p_type"))
    formats = F.array(F.when(F.col("p_size") % 3 == 0, "sandwich").otherwise("plate"))
    return table("part").select("p_partkey", no.repaired_category(c, F.col("p_brand"), formats, "Brand#1", ["sandwich", "finger-food"], ["PROMO", "other"]).alias("category"))


@query("SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS category, coalesce(c_name, 'none') AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def classification_overlay(table):
    details = table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("category"), F.lit("none").alias("label"))
    catalog = table("customer").filter("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("category"), F.col("c_name").alias("label"))
    return no.overlaid(details, catalog, "c_custkey", ["category", "label"]).select("o_orderkey", "category", "label")


@query("SELECT conv_id, turn, len(list_filter(string_split(text, '. '), lambda s: NOT regexp_matches(s, '(?i)^(hello|hi)') AND NOT regexp_matches(s, 'https?://'))) AS steps FROM conversations")
def real_steps(table):
    steps = no.real_steps(F.split("text", r"\. "), [r"(?i)^(hello|hi)", r"https?://"])
    return table("conversations").select("conv_id", "turn", F.size(steps).cast("long").alias("steps"))


@query("""
SELECT p_partkey, p_type, array_to_string(list_filter([CASE WHEN contains(' ' || p_name, ' re') THEN 'LARGE' END, CASE WHEN contains(' ' || p_name, ' ri') OR contains(' ' || p_name, ' bo') THEN 'SMALL' END], lambda x: x IS NOT NULL), ',') AS evidence
FROM part WHERE (contains(' ' || p_name, ' re') OR contains(' ' || p_name, ' ri') OR contains(' ' || p_name, ' bo'))
 AND NOT (p_type = 'LARGE' AND contains(' ' || p_name, ' re')) AND NOT (p_type = 'SMALL' AND (contains(' ' || p_name, ' ri') OR contains(' ' || p_name, ' bo')))""")
def category_evidence(table):
    return no.suspicious(table("part"), "p_partkey", "p_type", "p_name", {"LARGE": ["re"], "SMALL": ["ri", "bo"]}).select("p_partkey", "p_type", F.array_join("evidence", ",").alias("evidence"))


@query("SELECT p_type, p_brand, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, first) AS r FROM (SELECT p_type, p_brand, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2)) WHERE r <= 3")
def most_common_values(table):
    return se.most_common(table("part"), "p_type", "p_brand", "p_partkey", 3)


@query("""
SELECT p_partkey, total, has_more FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_name, p_partkey) AS r, count(*) OVER () AS total, 5 + 15 < count(*) OVER () AS has_more FROM part WHERE p_type = 'SMALL') WHERE r > 5 AND r <= 20""")
def counted_page(table):
    df = table("part").filter("p_type = 'SMALL'")
    rows = ex.counted_page(df, [F.desc("p_retailprice"), F.asc("p_name"), F.asc("p_partkey")], 15, 5)
    return rows.select("p_partkey", "total", "has_more")


# Personal records.


@query("SELECT o_custkey AS owner, 'orders' AS collection, CAST(o_orderkey AS VARCHAR) AS document_id, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\"}' AS payload, o_orderkey AS back FROM orders")
def personal_codec(table):
    rows = pe.encoded(table("orders"), "o_custkey", "orders", F.col("o_orderkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp")), ["o_orderpriority", "o_orderkey"])
    back = pe.decoded(rows, "orders", "o_orderkey long, o_orderpriority string").select("document_id", F.col("o_orderkey").alias("back"))
    return rows.join(back, "document_id").select("owner", "collection", "document_id", "payload", "back")


@query("SELECT c_custkey, n.note FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS note FROM orders GROUP BY 1) n ON n.o_custkey = c_custkey")
def customers_with_notes(table):
    notes = table("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderkey")
    return pe.with_notes(table("customer").select("c_custkey"), notes, "c_custkey", "o_orderpriority", "o_orderkey")


@query("""
SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (l_partkey % 3 = 0), '') AS parts, count(*) FILTER (l_partkey % 3 = 0) AS n
FROM (SELECT l_orderkey AS o_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS r FROM lineitem) WHERE r = 1 GROUP BY 1""")
def list_members(table):
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_partkey").alias("part"))
    lists = lines.groupBy("o_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "part"))), lambda x: x["part"]).alias("parts"))
    held = table("part").select(F.col("p_partkey").alias("part")).unionAll(table("lineitem").select("l_partkey")).filter("part % 3 = 0")
    return pe.list_members(lists, held, "o_orderkey", "part").select("o_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"), F.col("n").cast("long").alias("n"))


@query("""
SELECT p_type AS owner, token, CASE WHEN token = '' THEN 'blank' WHEN token = 'red ring' THEN 'reserved' ELSE 'repeated' END AS fault
FROM (SELECT p_type, trim(regexp_replace(lower(substr(p_name, 1, 40)), '[^a-z0-9]+', ' ', 'g')) AS token, count(*) AS n FROM part GROUP BY 1, 2) WHERE n > 1 OR token IN ('', 'red ring')""")
def list_names(table):
    rows = table("part").select(F.col("p_type").alias("owner"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("name"))
    return pe.name_faults(rows, "owner", "name", "Réd  Ring")


@query("SELECT o_orderkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'plan' END AS title, coalesce(c_mktsegment, 'none') AS image FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def today_content(table):
    plans = table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("date"), F.lit("plan").alias("title"), F.lit("none").alias("image"))
    today = plans.agg(F.max("date")).first()[0]
    items = table("customer").filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("title"), F.col("c_mktsegment").alias("image"))
    return pe.today_content(plans, items, "date", "c_custkey", F.lit(today)).select("o_orderkey", "title", "image")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'watch' WHEN event_type = 'view' THEN 'watch' ELSE event_type END AS category FROM events")
def resolved_categories(table):
    k = F.col("event_id")
    return table("events").select("event_id", pe.resolved_category({"view": "watch"}, F.when(k % 3 == 0, "view").otherwise(" "), F.when(k % 2 == 0, F.col("event_type")), F.col("event_type")).alias("category"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def completed_this_month(table):
    e = table("events").withColumn("date", F.to_date("ts"))
    return pe.completed_in(e, F.col("event_type") == "purchase", "date", F.lit("2024-01-17").cast("date")).select("event_id")


@query("""
WITH h AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k, o_orderpriority AS p FROM orders), r AS (SELECT k, p, CASE WHEN p = min(p) OVER (PARTITION BY k) THEN k ELSE k || '_' || substr(sha256(k || '|' || p), 1, 16) END AS renamed FROM h)
SELECT o_orderkey, renamed AS ref FROM orders JOIN r ON k = CAST(o_custkey AS VARCHAR) AND p = o_orderpriority""")
def remapped_references(table):
    o = table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("ref"), F.col("o_orderpriority").alias("p"))
    _, plans = pe.remapped(o.select(F.col("ref").alias("k"), "p").distinct(), o, "k", "p", "ref")
    return plans.select("o_orderkey", "ref")


@query("""
WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, event_type FROM events WHERE event_type IN ('view', 'click')), p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, CASE WHEN event_type = 'purchase' THEN 'click' ELSE event_type END AS event_type FROM events WHERE event_type IN ('purchase', 'view') AND value > 20)
SELECT 'cooked_' || substr(sha256(user_id || '|' || d || '|' || event_type), 1, 32) AS event_id, made FROM (SELECT *, false AS made FROM e UNION ALL SELECT *, true FROM (SELECT * FROM p EXCEPT SELECT * FROM e))""")
def normalized_history(table):
    e = table("events").withColumn("d", F.to_date("ts"))
    plans = e.filter("event_type IN ('purchase', 'view') AND value > 20").withColumn("event_type", F.when(F.col("event_type") == "purchase", "click").otherwise(F.col("event_type"))).withColumn("completed", F.lit(True))
    return pe.normalized_history(e.filter("event_type IN ('view', 'click')"), plans, "user_id", "d", "event_type").select("event_id", "made")


@query("""
WITH t AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events WHERE value < 30 GROUP BY 1, 2), p AS (SELECT DISTINCT user_id, event_type, user_id % 2 = 0 AS c FROM events)
SELECT user_id, event_type, c <> (coalesce(n, 0) % 2 = 1) AS completed, CASE WHEN c <> (coalesce(n, 0) % 2 = 1) AND last IS NOT NULL THEN 'cooked_' || substr(sha256(user_id || '|' || event_type || '|' || last), 1, 32) ELSE '' END AS event_id FROM p LEFT JOIN t USING (user_id, event_type)""")
def completed_courses(table):
    e = table("events")
    plans = e.select("user_id", "event_type").distinct().withColumn("completed", F.col("user_id") % 2 == 0)
    return pe.completed_courses(e.filter("value < 30"), plans, ["user_id", "event_type"], "event_id")[0].select("user_id", "event_type", "completed", "event_id")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'b,c,d' WHEN 1 THEN 'a,b' WHEN 2 THEN 'b' ELSE '' END AS toggled, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'b,d' WHEN 2 THEN 'a,b,d' ELSE '' END AS vegan FROM customer""")
def category_toggles(table):
    """Of a to d, a is tapped: with none excluded, with b, with a and b, with b, c and d (so a alone is shown). Vegan leaves a and c."""
    k = F.col("c_custkey") % 4
    lit = lambda s: F.array(*map(F.lit, s)) if s else F.array().cast("array<string>")
    excluded = F.when(k == 0, lit("")).when(k == 1, lit("b")).when(k == 2, lit("ab")).otherwise(lit("bcd"))
    sorted_ = lambda c: F.array_join(F.array_sort(c), ",")
    reconciled = pe.vegan_reconciled(lit("abcd"), F.when(k == 3, lit("ac")).otherwise(excluded), ["b", "d"])
    return table("customer").select("c_custkey", sorted_(pe.toggled_category(lit("abcd"), excluded, F.lit("a"))).alias("toggled"), sorted_(reconciled).alias("vegan"))


# Weekly plans: a week from each of twenty Mondays, parts of a type as candidates.


def cells(table) -> DataFrame:
    """Cells of 140 days: Tuesdays are completed, Wednesdays locked, Thursdays blank on purpose, Sundays' category has no candidates."""
    days = table("region").sparkSession.range(140).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    rows = days.select("date", F.explode(F.array(*map(F.lit, ("main", "side", "dessert")))).alias("course"))
    day = F.weekday("date")
    rows = rows.withColumn("category", pl.weekday_category(F.col("date"), {0: "SMALL", 4: "PROMO", 6: "none"}, "LARGE"))
    saved = F.when((day == 1) & (F.col("course") == "main"), 7).when((day == 5) & (F.col("course") != "dessert"), 9).cast("long")
    return rows.withColumns({"locked": day == 2, "completed": day == 1, "blank": day == 3, "item": saved})


def candidates(table) -> DataFrame:
    return table("part").select(F.col("p_type").alias("category"), F.col("p_partkey").alias("item"))


_CELLS = """
d AS (SELECT DATE '2024-01-01' + CAST(i AS INTEGER) AS date FROM range(140) t(i)),
c AS (SELECT date, course, isodow(date) - 1 AS day, CASE isodow(date) - 1 WHEN 0 THEN 'SMALL' WHEN 4 THEN 'PROMO' WHEN 6 THEN 'none' ELSE 'LARGE' END AS category,
 CASE WHEN isodow(date) = 2 AND course = 'main' THEN 7 WHEN isodow(date) = 6 AND course <> 'dessert' THEN 9 END AS saved, isodow(date) IN (2, 3, 4) AS kept FROM d, (VALUES ('main'), ('side'), ('dessert')) t(course)),
n AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3), p_partkey) - 1 AS nth, count(*) OVER (PARTITION BY p_type) AS total FROM part)"""


def _plan_sql(wanted: str, seed: int, draw: int) -> str:
    place = f"CAST('0x' || substr(sha256('{seed}|' || c.date || '|' || c.course || '|{draw}'), 1, 15) AS BIGINT)"
    return f"""WITH {_CELLS}
SELECT CAST(c.date AS VARCHAR) AS date, c.course, CASE WHEN {wanted} THEN n.p_partkey ELSE saved END AS item FROM c LEFT JOIN n ON n.p_type = c.category AND n.nth = {place} % n.total"""


def _shown(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("date").cast("string").alias("date"), "course", "item")


@query(_plan_sql("NOT kept AND course = 'main' AND (saved IS NULL OR saved = 9)", 11, 0))
def week_plan(table):
    return _shown(pl.ensured(cells(table), candidates(table), 11, usable=F.col("item") != 9))


@query(_plan_sql("NOT kept", 11, 3))
def week_reroll(table):
    return _shown(pl.rerolled_week(cells(table), candidates(table), 11, 3))


@query(_plan_sql("c.date = DATE '2024-01-18' AND course = 'main'", 11, 4))
def cell_reroll(table):
    """A blank Thursday is asked for."""
    return _shown(pl.rerolled(cells(table), candidates(table), 11, 4, F.lit("2024-01-18").cast("date"), "main"))


@query(_plan_sql("c.date = DATE '2024-01-20' AND course <> 'main' AND saved IS NULL", 11, 0))
def menu_suggestion(table):
    return _shown(pl.menu(cells(table), candidates(table), 11, F.lit("2024-01-20").cast("date")))


# Plans by each cell's own filters: parts as candidates, some of them favourites.


def filtered_cells(table) -> DataFrame:
    """cells() with filters of their own: sides of any category on some days, limits that come and go, and few distinct sets of them."""
    day = F.weekday("date")
    rows = cells(table).withColumn("category", F.when((F.col("course") == "side") & (day % 2 == 0), "any").otherwise(F.col("category")))
    return rows.withColumns({"ease": F.when(day == 4, "easy"), "min_rating": F.when(day == 0, 905.0).otherwise(0.0), "max_minutes": F.when(day == 5, 30).otherwise(0)})


def filtered_candidates(table) -> DataFrame:
    size = F.col("p_size")
    ease_ = F.when(size % 2 == 0, "easy").otherwise("hard")
    return table("part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("category"), ease_.alias("ease"), F.col("p_retailprice").alias("rating"), size.alias("minutes"), (size % 3 == 0).alias("for_side"))


def _filtered_sql(wanted: str, seed: int, draw: int, pool: str = "true", category: str = "category") -> str:
    """Each course in turn: the candidates of a cell's own filters in their order, from the place that is drawn, around the end, the first that isn't another course's."""
    place = f"CAST('0x' || substr(sha256('{seed}|' || date || '|' || course || '|{draw}'), 1, 15) AS BIGINT)"
    start = f"""WITH {_CELLS.replace("isodow(date) IN (2, 3, 4) AS kept", "isodow(date) IN (2, 3, 4) AS kept, isodow(date) - 1 AS wd")},
q AS (SELECT p_partkey, p_type, CASE WHEN p_size % 2 = 0 THEN 'easy' ELSE 'hard' END AS ease, p_retailprice, p_size, substr(md5(CAST(p_partkey AS VARCHAR)), 1, 3) AS h FROM part WHERE p_type NOT IN ('other') AND {pool}),
f0 AS (SELECT date, course, CASE WHEN course = 'side' AND wd % 2 = 0 THEN 'any' ELSE category END AS category, saved AS item, kept, wd, CASE WHEN wd = 4 THEN 'easy' END AS ease, CASE WHEN wd = 0 THEN 905.0 ELSE 0 END AS least, CASE WHEN wd = 5 THEN 30 ELSE 0 END AS most FROM c),
f AS (SELECT date, course, {category} AS category, item, kept, ease, least, most, {wanted} AS wanted FROM f0),
m AS (SELECT f.date, f.course, p_partkey, row_number() OVER w - 1 AS nth, count(*) OVER (PARTITION BY f.date, f.course) AS total FROM f JOIN q ON (f.category = 'any' OR q.p_type = f.category)
 AND (f.ease IS NULL OR q.ease = f.ease) AND (f.least = 0 OR q.p_retailprice > f.least) AND (f.most = 0 OR (q.p_size > 0 AND q.p_size <= f.most)) AND (NOT (f.course = 'side' AND f.category = 'any') OR (q.p_size % 3 = 0 AND q.p_type <> 'dessert'))
 WHERE f.wanted WINDOW w AS (PARTITION BY f.date, f.course ORDER BY h, p_partkey)),
t AS (SELECT date, course, p_partkey, (nth - {place} % total + total) % total AS tries, total FROM m)"""
    steps, last = [], "f"
    for k, course in enumerate(("main", "side", "dessert")):
        clear = "true" if course == "main" else f"t.p_partkey NOT IN (SELECT item FROM {last} o WHERE o.date = t.date AND o.course <> '{course}' AND o.item IS NOT NULL)"
        steps.append(f"""s{k} AS MATERIALIZED (SELECT l.date, l.course, CASE WHEN l.wanted AND l.course = '{course}' THEN b.item ELSE l.item END AS item, l.wanted FROM {last} l
 LEFT JOIN (SELECT date, arg_min(p_partkey, tries) AS item FROM t WHERE course = '{course}' AND tries < 3 AND {clear} GROUP BY date) b ON b.date = l.date)""")
        last = f"s{k}"
    return ",\n".join([start, *steps]) + f"\nSELECT CAST(date AS VARCHAR) AS date, course, item FROM {last}"


@query(_filtered_sql("NOT kept", 5, 2))
def filtered_reroll(table):
    rows = filtered_cells(table)
    return _shown(pl.planned(rows, filtered_candidates(table), 5, ~pl.kept_cell(), draw=2))


@query(_filtered_sql("NOT kept", 5, 1, "p_partkey % 4 = 0 AND p_partkey % 12 <> 0"))
def favourite_reroll(table):
    """Favourites only, without those that the week leaves out."""
    part = table("part").select(F.col("p_partkey").alias("item"))
    choice = pl.Choice(favourites=part.filter("item % 4 = 0"), week_excluded=part.filter("item % 12 = 0"))
    return _shown(pl.planned(filtered_cells(table), filtered_candidates(table), 5, ~pl.kept_cell(), choice, draw=1))


@query(_filtered_sql("NOT kept AND ((course = 'main' AND (item IS NULL OR item = 9)) OR (course = 'main' AND wd IN (1, 5)) OR (course = 'side' AND wd = 5 AND item IS NOT NULL))", 3, 0, category="CASE WHEN NOT kept AND course = 'main' AND wd IN (1, 5) THEN CASE wd WHEN 5 THEN 'PROMO' ELSE 'any' END WHEN NOT kept AND course = 'side' AND wd = 5 AND item IS NOT NULL THEN 'SMALL' ELSE category END"))
def week_resets(table):
    """Tuesdays' and Saturdays' main courses and Saturdays' sides go back to the weekday's category; Tuesdays are done, so they stay."""
    rows = filtered_cells(table)
    out = pl.ensured_week(rows, filtered_candidates(table), 3, F.col("item") != 9, {"main": {1, 5}, "side": {5}}, {"main": {5: "PROMO"}, "side": {5: "SMALL"}})
    return _shown(out)


@query("SELECT p_partkey FROM part WHERE p_type = 'SMALL' AND p_size % 2 = 0 AND p_brand NOT IN ('Brand#2')")
def active_language_rows(table):
    """Criteria with the gate that every candidate passes: active, and of a language."""
    c = {"category": F.col("p_type"), "source": F.col("p_brand"), "active": F.col("p_size") % 2 == 0, "language": F.when(F.col("p_partkey") % 2 == 0, "el").otherwise("EL-gr")}
    q = ex.Criteria(category="SMALL", language="el", preferences=ex.Preferences(frozenset({"Brand#2"}), frozenset()))
    return table("part").filter(ex.predicate(q, c)).select("p_partkey")


@query("SELECT token, min(label) AS label, count(*) AS n FROM (SELECT lower(p_type) AS token, p_type AS label FROM part) GROUP BY 1")
def label_tokens(table):
    rows = table("part").select(F.lit("f").alias("facet"), F.lower("p_type").alias("token"), F.col("p_type").alias("label"), "p_partkey")
    n = rows.groupBy("token").agg(F.count("*").alias("n"))
    return fa.first_labels(rows, "p_partkey").join(n, "token").select("token", "label", "n")


@query("""
SELECT p_partkey, CASE WHEN contains(' ' || p_name || ' ', ' red ') THEN 'colour' WHEN contains(' ' || p_name || ' ', ' bolt ') THEN 'fastener' WHEN contains(' ' || p_name || ' ', ' ring ') THEN 'jewel' WHEN contains(' ' || p_name || ' ', ' blue ') THEN 'colour' ELSE 'other' END AS category FROM part""")
def category_rules(table):
    """Rules as a table: red is final whatever else, then bolt before ring before blue."""
    rules = table("region").sparkSession.createDataFrame([("Ring", "jewel", 2, False), ("bolt", "fastener", 1, False), ("RED", "colour", 9, True), ("blue", "colour", 3, False)], "label string, category string, rank int, final boolean")
    return no.by_rules(table("part"), "p_partkey", F.split("p_name", " "), rules, "other")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '0;1,2;3' WHEN 1 THEN '0,1,2,3' WHEN 2 THEN 'none' ELSE 'none' END AS places FROM orders")
def anchored_steps(table):
    """Four steps against anchors that are one or some of them; the third kind leaves a step over, the last has a foreign one."""
    k = F.col("o_orderkey") % 4
    steps = F.array(F.col("o_orderpriority"), F.lit("a b"), F.lit("c"), F.col("o_orderstatus"))
    joined = F.array_join(steps, " ")
    anchors = F.when(k == 0, F.array(steps[0], F.lit("a b c"), steps[3])).when(k == 1, F.array(joined)).when(k == 2, F.array(steps[0], steps[1])).otherwise(F.array(steps[0], F.lit("x"), steps[2], steps[3]))
    places = no.anchored(steps, anchors)
    shown = F.array_join(F.transform(places, lambda p: F.array_join(F.transform(p, lambda i: i.cast("string")), ",")), ";")
    return table("orders").select("o_orderkey", F.coalesce(shown, F.lit("none")).alias("places"))


@query("SELECT a.p_partkey, CAST(levenshtein(a.p_name || a.p_type, b.p_name || b.p_brand) AS INTEGER) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def name_distances(table):
    """Letters of a part's name and type against the next one's name and brand."""
    part = table("part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", "p_brand").alias("right"))
    both = dealt(part.select("p_partkey", F.concat("p_name", "p_type").alias("left")).join(after, "p_partkey"), "p_partkey")
    both = both.select("p_partkey", *(F.split(c, "").alias(c) for c in ("left", "right")))
    return al.alignments(both, "p_partkey", "left", "right").select("p_partkey", "distance")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'A:' || o_orderpriority || '>rest;B:c d' WHEN 1 THEN ':' || o_orderpriority || '>rest>c d' WHEN 2 THEN 'none' ELSE 'A:' || o_orderpriority || '>rest>c d' END AS sections,
 CASE o_orderkey % 4 WHEN 2 THEN '' ELSE 'tip' || CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE '>' || o_orderstatus END END AS tips FROM orders WHERE o_orderkey % 4 < 3
UNION ALL SELECT o_orderkey, 'A:' || o_orderpriority || '>rest>c d', 'tip>' || o_orderstatus FROM orders WHERE o_orderkey % 4 = 3""")
def grouped_steps(table):
    """Five steps against two headings and tips, tips alone, headings in the wrong order, and one heading whose anchors leave steps out."""
    k, p = F.col("o_orderkey") % 4, F.col("o_orderpriority")
    steps = F.array(p, F.lit("rest"), F.lit("c d"), F.lit("tip"), F.col("o_orderstatus"))
    group = lambda title, tip, *anchors: F.struct(F.lit(title).alias("title"), F.lit(tip).alias("tip"), F.array(*anchors).alias("steps"))
    c, d, tip, rest = (F.lit(x) for x in ("c", "d", "tip", "rest"))
    groups = F.when(k == 0, F.array(group("A", False, p, rest), group("B", False, c, d), group("", True, tip))).when(k == 1, F.array(group("", True, tip)))
    groups = groups.when(k == 2, F.array(group("B", False, c, d), group("A", False, p))).otherwise(F.array(group("A", False, p, c, d), group("", True, tip)))
    found = al.grouped_methods(table("orders").select("o_orderkey", steps.alias("steps"), groups.alias("groups")), "o_orderkey", "steps", "groups")
    sections = F.array_join(F.transform("method.sections", lambda s: F.concat(s["title"], F.lit(":"), F.array_join(s["steps"], ">"))), ";")
    return found.select("o_orderkey", F.coalesce(sections, F.lit("none")).alias("sections"), F.coalesce(F.array_join("method.tips", ">"), F.lit("")).alias("tips"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN NULL ELSE 'b' END AS provider, c_custkey % 6 = 1 AS conflict FROM customer")
def provider_resolution(table):
    k = F.col("c_custkey")
    key = F.when(k % 3 == 0, " A ").when(k % 6 == 1, "a")
    host = F.when(k % 3 == 2, "b.org").when(k % 6 == 1, "b.org")
    found = no.provider_of({"key": key, "host": host}, {"key": {"a": "a"}, "host": {"b.org": "b"}})
    return table("customer").select("c_custkey", found.alias("x")).select("c_custkey", "x.*")


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE '' END, ''), CASE WHEN p_partkey % 2 = 0 THEN 'site' ELSE 'b.org' END) AS source FROM part")
def effective_sources(table):
    k = F.col("p_partkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://www.A.org/"), k)).otherwise(F.concat(F.lit("https://b.org/"), k))
    return table("part").select("p_partkey", pr.effective_source(F.when(k % 3 == 0, F.col("p_brand")).otherwise(" "), url, {"a.org": "site"}).alias("source"))


@query("""
SELECT p_partkey, '{"p_name":"' || p_name || '","p_size":' || p_size || '}' AS summary, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' AS detail FROM part""")
def document_projections(table):
    return pr.documents(table("part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type"), "p_partkey", ["p_size", "p_name"], ["p_type"])


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND p_type <> 'PROMO'")
def known_choices(table):
    """Stale choices among the criteria are as if they weren't there."""
    q = ex.Criteria(sources=frozenset({"Brand#1", "gone"}), preferences=ex.Preferences(frozenset({"old"}), frozenset({"PROMO", "stale"})))
    q = ex.known_only(q, frozenset({"Brand#1", "Brand#2"}), frozenset({"PROMO", "SMALL"}))
    return table("part").filter(ex.predicate(q, {"category": F.col("p_type"), "source": F.col("p_brand")})).select("p_partkey")

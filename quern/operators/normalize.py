"""Normalizers: payloads of services to records, sections, labels and tags to one form. Vocabularies are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import declared, substantive
from ..functions.parse import canonical_url, ease, iso_minutes, quick, rating_doubled, safe_number, stable_key, total_minutes, wait_minutes
from ..functions.text import ordered_distinct, search_token
from .alignment import grouped_methods

#: What a payload's JSON holds of a record. Every field may be missing.
PAYLOAD = (
    "id string, title string, language string, url string, categories string, tags array<string>, make_time string, bake_time string, wait_time string, average_score string, votes string, "
    "ingredient_sections array<struct<title:string,ingredients:array<struct<title:string,quantity:string,unit:string,info:string>>>>, method array<struct<section:string,steps:array<string>>>"
)


def clean(text: Column) -> Column:
    """Trimmed, white space as single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def shaped_ingredients(sections: Column) -> Column:
    """Sections with clean fields, without ingredients that have no title, without sections that have no ingredients."""
    one = lambda i: F.struct(*(clean(i[k]).alias(k) for k in ("title", "quantity", "unit", "info")))
    shape = lambda s: F.struct(clean(s["title"]).alias("title"), F.filter(F.transform(F.coalesce(s["ingredients"], F.array()), one), lambda i: i["title"] != "").alias("ingredients"))
    return F.filter(F.transform(sections, shape), lambda s: F.size(s["ingredients"]) > 0)


def shaped_method(sections: Column) -> Column:
    """Sections of clean steps, without blank ones."""
    shape = lambda s: F.struct(clean(s["section"]).alias("title"), text_list(s["steps"]).alias("steps"))
    return F.filter(F.transform(sections, shape), lambda s: F.size(s["steps"]) > 0)


def text_list(values: Column) -> Column:
    """Clean texts, without blank ones, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean), lambda x: x != ""))


def records_of_payloads(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Records from payloads' JSON: sections, times, rating, counts, bands and keys. A payload that can't be read gives a record without a title."""
    p = payloads.select(key, F.from_json(payload, PAYLOAD).alias("p")).select(key, "p.*")
    p = p.withColumns({"ingredientSections": shaped_ingredients(F.coalesce("ingredient_sections", F.array())), "methodSections": shaped_method(F.coalesce("method", F.array()))})
    minutes = lambda c: F.coalesce(iso_minutes(F.col(c)), F.when(F.length(c) > 0, wait_minutes(F.col(c))))
    p = p.withColumns({"prepMinutes": minutes("make_time"), "cookMinutes": minutes("bake_time"), "waitMinutes": minutes("wait_time")})
    count = lambda c, of: F.aggregate(c, F.lit(0), lambda acc, s: acc + F.size(s[of]))
    total = F.coalesce(total_minutes(F.lit(None).cast("long"), F.col("prepMinutes"), F.col("cookMinutes"), F.col("waitMinutes")), F.lit(0))
    score = safe_number(F.col("average_score"))
    p = p.withColumns({"totalMinutes": total, "preparationCount": count("ingredientSections", "ingredients"), "stepCount": count("methodSections", "steps"), "rating10": rating_doubled(score, score)})
    return p.select(
        key, clean(F.col("title")).alias("title"), F.lower(clean(F.col("language"))).alias("language"), canonical_url(F.col("url")).alias("canonicalUrl"), text_list(F.col("tags")).alias("tags"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("prepMinutes", "cookMinutes", "waitMinutes")), "totalMinutes", "preparationCount", "stepCount", "rating10", "ingredientSections", "methodSections",
        ease(F.size("ingredientSections"), F.col("stepCount")).alias("ease"), quick(F.col("totalMinutes")).alias("quickRecipe"), stable_key(F.coalesce(F.col("id"), F.lit(""))).alias("randomKey"),
    )


def linked_data(objects: DataFrame, key: str, data: str) -> DataFrame:
    """Records from JSON-LD objects (one JSON text each): name, times by ISO 8601, rating of its best, steps from texts or HowToStep objects."""
    got = lambda path: F.get_json_object(data, f"$.{path}")
    step = lambda s: clean(F.coalesce(F.get_json_object(s, "$.text"), s))
    # What is used more than once is a column of its own, so that it is computed once.
    objects = objects.select(key, data, *(got(f).alias(f"_{f}") for f in ("prepTime", "cookTime", "totalTime")))
    objects = objects.select(key, data, *(iso_minutes(F.col(f"_{f}")).alias(f"_{f}") for f in ("prepTime", "cookTime", "totalTime")),
                             safe_number(got("aggregateRating.ratingValue")).alias("_value"), F.coalesce(got("aggregateRating.bestRating").try_cast("double"), F.lit(5.0)).alias("_best"), F.from_json(got("recipeInstructions"), "array<string>").alias("_steps"))
    prep, cook, whole, value, best, steps = (F.col(f"_{c}") for c in ("prepTime", "cookTime", "totalTime", "value", "best", "steps"))
    return objects.select(
        key, clean(got("name")).alias("title"), F.coalesce(prep, F.lit(0)).alias("prepMinutes"), F.coalesce(cook, F.lit(0)).alias("cookMinutes"),
        F.coalesce(F.greatest(whole, total_minutes(F.lit(None).cast("long"), prep, cook)), F.lit(0)).alias("totalMinutes"),
        F.when(value.between(0, best) & (best > 0), F.round(value / best * 10, 2)).otherwise(0.0).alias("rating10"),
        text_list(F.transform(F.coalesce(steps, F.array().cast("array<string>")), step)).alias("steps"),
        text_list(F.from_json(got("recipeIngredient"), "array<string>")).alias("ingredients"),
    )


def gated(records: DataFrame, lang: Column, text: Column, code: str, kind: str, other: str) -> DataFrame:
    """Records that say they are of a language, and whose text is: enough letters of its script, and no fewer than of another (see language.substantive)."""
    return records.filter(declared(lang, code) & substantive(text, kind, other))


def with_sections(records: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """records (key, steps, ...) with sections and tips: by the headings of their pages (key, groups: see alignment.method_groups) where these agree with the steps; else, as without a page, all steps are one section without title."""
    found = grouped_methods(records.select(key, "steps").join(pages.select(key, "groups"), key), key, "steps", "groups")
    both = records.join(found.filter(F.size("method.sections") > 0), key, "left")
    whole = F.array(F.struct(F.lit("").alias("title"), F.col("steps").alias("steps")))
    return both.withColumns({"sections": F.coalesce("method.sections", whole), "tips": F.coalesce("method.tips", F.array().cast("array<string>"))}).drop("method")


def drafts(rows: DataFrame, key: str, sections: str, most: int = 200) -> DataFrame:
    """(key, place, title, quantity, unit, info): the ingredients of all sections in a row, cut to a length; those without a title go."""
    cut = lambda c: F.trim(F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, most))
    flat = rows.select(key, F.posexplode(F.flatten(F.transform(sections, lambda s: s["ingredients"]))).alias("place", "i"))
    fields = [cut(F.col(f"i.{f}")).alias(f) for f in ("title", "quantity", "unit", "info")]
    return flat.select(key, "place", *fields).filter("title <> ''")


def ingredient_texts(rows: DataFrame, key: str, sections: str) -> DataFrame:
    """(key, text): of each ingredient its title and info as one token text, each once; amounts and units don't count, and no text runs over two ingredients."""
    flat = rows.select(key, F.explode(F.flatten(F.transform(sections, lambda s: s["ingredients"]))).alias("i"))
    return flat.select(key, search_token(F.concat_ws(" ", "i.title", "i.info")).alias("text")).filter("text <> ''").distinct()


def nutrition_rows(rows: DataFrame, key: str, nutrients: dict[str, dict[str, str]]) -> DataFrame:
    """(key, nutrient, and a column for each measure): nutrient -> measure -> column; rows whose measures are all blank go."""
    measures = list(dict.fromkeys(m for of in nutrients.values() for m in of))
    value = lambda c: clean(F.col(c).cast("string")) if c else F.lit("")
    table = F.array(*(F.struct(F.lit(name).alias("nutrient"), *(value(of.get(m)).alias(m) for m in measures)) for name, of in nutrients.items()))
    out = rows.select(key, F.explode(table).alias("x")).select(key, "x.*")
    return out.filter(reduce(lambda a, b: a | b, (F.col(m) != "" for m in measures)))


def renamed_fields(source: Column, names: dict[str, str]) -> Column:
    """A map with the known keys of another under their own names; blank values and unknown keys go."""
    table = F.create_map(*(F.lit(x) for p in sorted(names.items()) for x in p))
    known = F.map_filter(source, lambda k, v: table[k].isNotNull() & (clean(v) != ""))
    return F.transform_keys(known, lambda k, v: table[k])


def alias_table(groups: dict[str, list[str]]) -> dict[str, str]:
    """Token of each alias -> label of its group."""
    return {a: label for label, aliases in sorted(groups.items()) for a in aliases}


def canonical_labels(labels: Column, aliases: dict[str, str]) -> Column:
    """Labels split at commas, each under its alias's label, one of each token, in order of their tokens."""
    table = F.create_map(*(F.lit(x) for p in sorted(aliases.items()) for x in p))
    parts = F.filter(F.flatten(F.transform(labels, lambda x: F.split(x, ","))), lambda x: F.trim(x) != "")
    named = F.transform(parts, lambda x: F.coalesce(table[search_token(x)], F.trim(x)))
    keyed = F.array_sort(F.transform(ordered_distinct(named, search_token), lambda x: F.struct(search_token(x).alias("k"), x.alias("v"))))
    return F.transform(keyed, lambda x: x["v"])


def expanded(tokens: frozenset[str], groups: dict[str, list[str]]) -> frozenset[str]:
    """Tokens with all the others of their groups: what an exclusion of one of them means."""
    return tokens | {a for of in groups.values() if tokens & set(of) for a in of}


def canonical_tags(tags: Column, aliases: dict[str, str]) -> Column:
    """Tags whose token is an alias under its label, others as they are; each token once, in order."""
    table = F.create_map(*(F.lit(x) for p in sorted(aliases.items()) for x in p))
    return ordered_distinct(F.transform(tags, lambda t: F.coalesce(table[search_token(t)], t)), search_token)


def repaired_category(category: Column, source: Column, formats: Column, provider: str, street: list[str], final: list[str] = ("dessert", "other")) -> Column:
    """Categories of older records: the provider's rows of a street format are street food, other rows that say so aren't; dessert and other stay."""
    of_street = (source == provider) & F.arrays_overlap(formats, F.array(*map(F.lit, street)))
    return F.when(category.isin(*final), category).when(of_street, "street_food").when(category == "street_food", "other").otherwise(category)


def overlaid(details: DataFrame, catalog: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Detail rows with the catalog's values of some fields where it has the row and a value."""
    own = catalog.select(key, *(F.col(f).alias(f"_own_{f}") for f in fields))
    out = details.join(own, key, "left")
    return out.withColumns({f: F.coalesce(f"_own_{f}", f) for f in fields}).drop(*(f"_own_{f}" for f in fields))


def real_steps(steps: Column, unwanted: list[str]) -> Column:
    """Steps without those that a pattern of previews, advertisements, grids or greetings meets."""
    return F.filter(steps, lambda s: ~reduce(lambda a, b: a | b, (s.rlike(p) for p in unwanted)))


def category_evidence(text: Column, groups: dict[str, list[str]]) -> Column:
    """Groups one of whose stems a word of the text begins with."""
    words = F.concat(F.lit(" "), search_token(text))
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.contains(words, F.lit(f" {s}")) for s in stems)), F.lit(g)) for g, stems in sorted(groups.items()))))


def suspicious(df: DataFrame, key: str, category: str, text: str, groups: dict[str, list[str]]) -> DataFrame:
    """(key, category, evidence): rows whose text speaks of groups, their category not among them."""
    found = df.select(key, category, category_evidence(F.col(text), groups).alias("evidence"))
    return found.filter((F.size("evidence") > 0) & ~F.array_contains("evidence", F.col(category)))


def by_rules(rows: DataFrame, key: str, labels: str, rules: DataFrame, other: str) -> DataFrame:
    """(key, category): rules (label, category, rank, final) are joined on tokens of the labels; a final rule comes before all others, then the least rank decides, then the category's name. The rules are a vocabulary, so small, and the join is left to choose how."""
    each = rows.select(key, F.explode_outer(F.array_distinct(F.transform(labels, search_token))).alias("label"))
    known = rules.select(search_token(F.col("label")).alias("label"), "category", F.struct((~F.col("final")).alias("later"), "rank", F.col("category").alias("name")).alias("_order"))
    return each.join(known, "label", "left").groupBy(key).agg(F.coalesce(F.min_by("category", "_order"), F.lit(other)).alias("category"))


def anchored(steps: Column, anchors: Column, most: int = 4) -> Column:
    """For each anchor the places of the steps that it is made of: steps follow one another, and an anchor is one to `most` of them joined by spaces. Null where they don't all go together."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("found"), F.lit(True).alias("fine"))

    def step(acc: Column, anchor: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: (acc["at"] + n <= F.size(steps)) & (F.array_join(F.slice(steps, acc["at"] + 1, n), " ") == anchor))
        n = F.get(fits, F.lit(0))
        taken = F.when(n.isNotNull(), F.sequence(acc["at"], acc["at"] + n - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct((acc["at"] + F.coalesce(n, F.lit(0))).alias("at"), F.concat(acc["found"], F.array(taken)).alias("found"), (acc["fine"] & n.isNotNull()).alias("fine"))

    end = F.aggregate(anchors, start, step)
    return F.when(end["fine"] & (end["at"] == F.size(steps)), end["found"])


def provider_of(signals: dict[str, Column], names: dict[str, dict[str, str]]) -> Column:
    """struct(provider, conflict): each signal (such as key, domain, host) says a provider by its own table; those that say none don't count, and different ones are a conflict."""
    said = []
    for name, c in sorted(signals.items()):
        table = F.create_map(*(F.lit(x) for p in sorted(names[name].items()) for x in p))
        said.append(table[F.lower(F.trim(c))])
    distinct = F.array_distinct(F.array_compact(F.array(*said)))
    return F.struct(F.when(F.size(distinct) == 1, distinct[0]).alias("provider"), (F.size(distinct) > 1).alias("conflict"))

"""Gates by language and script."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def declared(lang: Column, code: str) -> Column:
    """The language, or a region of it: 'el', 'el-GR', 'EL_gr'."""
    return F.coalesce(F.lower(F.trim(lang)).rlike(f"^{code}($|[-_])"), F.lit(False))


def active_in(active: Column, lang: Column, code: str) -> Column:
    return F.coalesce(active, F.lit(False)) & declared(lang, code)


def eligible(active: Column, lang: Column, id_: Column, asked: Column, code: str) -> Column:
    """What may be published: active, exactly that language, and the row that was asked for."""
    return F.coalesce(active & (lang == code) & (id_ == asked), F.lit(False))


def letters(text: Column, kind: str) -> Column:
    """How many letters of a class of characters a text has."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{kind}]", ""))


def has_script(text: Column, kind: str) -> Column:
    return F.coalesce(text.rlike(f"[{kind}]"), F.lit(False))


def substantive(text: Column, kind: str, other: str, least: int = 3) -> Column:
    """At least some letters of a script, and no fewer than of another."""
    mine = letters(text, kind)
    return (mine >= least) & (mine >= letters(text, other))

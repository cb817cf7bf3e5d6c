"""Rules on clauses of a text: what a clause speaks of, and what in it takes that back. Vocabularies are parameters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, neighbourhood, search_token, words


@dataclass(frozen=True)
class ClauseRules:
    """kinds: kind -> (exact tokens, stems). negations: stems that, right before a token, take it back. qualifiers: stems that do so within `reach` tokens, for every kind. bases: kind -> stems that do so within reach for that kind."""

    kinds: dict[str, tuple[tuple[str, ...], tuple[str, ...]]]
    negations: tuple[str, ...] = ("without", "no")
    qualifiers: tuple[str, ...] = ("vegan",)
    bases: dict[str, tuple[str, ...]] = None
    alternatives: str = r"(?iu)\s+(?:or|ή)\s+|/"
    reach: int = 3


def has_stem(token: Column, stems: tuple[str, ...]) -> Column:
    """Stems are prefixes, so 'no' is one of 'noodles' too."""
    return reduce(or_, (F.startswith(token, F.lit(s)) for s in stems), F.lit(False))


def _any_stem(tokens: Column, stems: tuple[str, ...]) -> Column:
    return F.exists(tokens, lambda t: has_stem(t, stems))


def kind_of(token: Column, rules: ClauseRules) -> Column:
    out = F.lit(None).cast("string")
    for kind, (exact, stems) in reversed(list(rules.kinds.items())):
        out = F.when(token.isin(*exact) | has_stem(token, stems), kind).otherwise(out)
    return out


def unqualified(text: Column, rules: ClauseRules) -> Column:
    """A clause of the text names a kind that nothing takes back. Alternatives are clauses of their own, so what qualifies one says nothing of another."""

    def clause(c: Column) -> Column:
        marked = neighbourhood(words(search_token(c)), rules.reach)
        kinds = F.transform(marked, lambda x: F.struct(x["token"].alias("token"), x["near"].alias("near"), kind_of(x["token"], rules).alias("kind"), F.coalesce(has_stem(x["previous"], rules.negations), F.lit(False)).alias("negated")))

        def open_(x: Column, taken_back: Column) -> Column:
            qualified = _any_stem(x["near"], rules.qualifiers)
            based = F.lit(False)
            for kind, stems in (rules.bases or {}).items():
                based = based | ((x["kind"] == kind) & _any_stem(x["near"], stems))
            return x["kind"].isNotNull() & ~(x["negated"] | F.coalesce(F.array_contains(taken_back, x["kind"]), F.lit(False)) | qualified | based)

        def any_open(marked_kinds: Column) -> Column:
            taken_back = F.transform(F.filter(marked_kinds, lambda x: x["negated"]), lambda x: x["kind"])
            return bound(taken_back, lambda b: F.exists(marked_kinds, lambda x: open_(x, b)))

        return bound(kinds, any_open)

    return F.exists(F.split(F.coalesce(text, F.lit("")), rules.alternatives), clause)


@dataclass(frozen=True)
class TimingRules:
    """Patterns of a sentence that orders something, of one that doesn't bind, and of waiting overnight; words for numbers; units in minutes. A duration that an alternative stands before doesn't bind."""

    action: str = r"(?iu)\b(?:leave|place|bake|boil|simmer|cook|rest|marinate|soak|chill|freeze|wait)\b"
    optional: str = r"(?iu)\b(?:if|can|may|optional\w*|alternatively|ideally|keeps?|store)\b"
    overnight: str = r"(?iu)\b(?:overnight|all night|until the next day)\b"
    numbers: tuple[tuple[str, float], ...] = (("half an", 0.5), ("half a", 0.5), ("an", 1), ("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("eight", 8), ("ten", 10), ("twelve", 12), ("twenty", 20), ("thirty", 30))
    units: tuple[tuple[str, int], ...] = (("days?", 1440), ("hours?", 60), ("minutes?", 1), ("min", 1))
    range_words: str = r"-|–|to"
    alternative: str = r"\bor\s+"


def _amount_of(text: Column, numbers: tuple[tuple[str, float], ...]) -> Column:
    """A word for a number, a fraction, or a decimal number."""
    plain = F.lower(F.regexp_replace(text, r"\s+", " "))
    out = F.coalesce(F.replace(plain, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    parts = F.split(plain, r"\s*/\s*")
    out = F.when(F.size(parts) == 2, F.coalesce(F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")), F.lit(0.0))).otherwise(out)
    for word, n in numbers:
        out = F.when(plain == word, float(n)).otherwise(out)
    return out


def timing_contradictions(steps: Column, total: Column, rules: TimingRules = TimingRules()) -> Column:
    """Sentences of the steps that must be done and take longer than the whole is said to: the total can't be right. Of a range its lower end counts."""
    sentences = F.flatten(F.transform(steps, lambda s: F.split(s, r"(?<=[.!?;])\s+|\n+")))
    amount = rf"\d+\s*/\s*\d+|\d+(?:[.,]\d+)?|\b(?:{'|'.join(w for w, _ in rules.numbers)})"
    unit = "|".join(u for u, _ in rules.units)
    duration = rf"(?iu)({rules.alternative})?({amount})\s*(?:(?:{rules.range_words})\s*(?:{amount})\s*)?({unit})\b"

    def worth(u: Column) -> Column:
        out = F.lit(1)
        for pattern, minutes in reversed(rules.units):
            out = F.when(u.rlike(f"(?iu)^(?:{pattern})$"), minutes).otherwise(out)
        return out

    def minutes(s: Column) -> Column:
        either, n, u = (F.regexp_extract_all(s, F.lit(duration), k) for k in (1, 2, 3))
        binding = F.filter(F.arrays_zip(either.alias("either"), n.alias("n"), u.alias("u")), lambda p: p["either"] == "")
        return F.transform(binding, lambda p: _amount_of(p["n"], rules.numbers) * worth(p["u"]))

    binding = lambda s: s.rlike(rules.action) & ~s.rlike(rules.optional)
    longer = lambda s: F.exists(minutes(s), lambda m: m > total) | ((total < 30) & s.rlike(rules.overnight))
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.filter(sentences, lambda s: binding(s) & longer(s))).otherwise(F.array().cast("array<string>"))

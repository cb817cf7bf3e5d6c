"""Keys that make texts comparable: case, accents, scripts and punctuation folded away."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

def _decomposed() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters and numbers whose full decomposition, without marks, is another single character; and those that become several (ligatures, fractions, iota below), but for East Asian ones."""
    one, several = {}, {}
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c)[0] in "LN" and c == c.lower():
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).casefold() if unicodedata.category(x) != "Mn")
            if plain != c and len(plain) == 1:
                one[c] = plain
            elif c != "ß" and len(plain) > 1 and (c < "\u3000" or "\ufb00" <= c < "\ufb50"):
                several[c] = plain
    return one, several


SINGLE, SEVERAL = _decomposed()

# How Greek letters are written in Latin ones; an upsilon after a vowel makes a digraph.
GREEK_DIGRAPHS = [("ου", "ou"), ("αυ", "av"), ("ευ", "ev"), ("ηυ", "iv")]
GREEK_LETTERS = "αβγδεζηικλμνοπρστυφχω"
LATIN_LETTERS = "avgdeziiklmnoprstifho"
GREEK_DOUBLES = [("θ", "th"), ("ξ", "ks"), ("ψ", "ps")]
# Spellings of one sound, applied in this order.
LATIN_SOUNDS = [
    ("ch", "h"), ("kh", "h"), ("ph", "f"), ("sh", "s"),
    ("ce", "se"), ("ci", "si"), ("cy", "si"), ("c", "k"), ("q", "k"),
    ("w", "o"), ("y", "i"), ("j", "tz"), ("x", "h"),
    ("au", "av"), ("eu", "ev"), ("ou", "u"), ("oo", "u"), ("ee", "i"),
    ("ei", "i"), ("oi", "i"), ("ai", "e"),
    ("mp", "b"), ("nt", "d"), ("gk", "g"),
]


#: Stands for any letter that becomes several, in a text that is only looked through for them.
_LONGER = "\ue000"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """Lower case, fully decomposed, without marks. Plain ASCII is done once it is lower case; else one table turns single letters and shows whether there are any that become several, which are rare and replaced one by one."""
    one = lambda x: F.translate(x, "".join(SINGLE), "".join(SINGLE.values()))
    forms = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(plain).alias("plain")) for c, plain in SEVERAL.items()))
    longer = lambda x: F.aggregate(forms, x, lambda acc, f: F.replace(acc, f["c"], f["plain"]))
    looked = lambda x: F.translate(x, "".join(SINGLE) + "".join(SEVERAL), "".join(SINGLE.values()) + _LONGER * len(SEVERAL))
    bare = lambda x: F.replace(F.regexp_replace(x, r"\p{Mn}+", ""), F.lit("ß"), F.lit("ss"))
    marked = lambda x: _let(looked(x), lambda y: F.when(F.contains(y, F.lit(_LONGER)), one(longer(x))).otherwise(y))
    return _let(F.lower(F.coalesce(text, F.lit(""))), lambda x: F.when(F.octet_length(x) == F.char_length(x), x).otherwise(_let(bare(x), marked)))


def search_token(text: Column) -> Column:
    """Letters and digits of the folded text, other runs one space. Null is empty."""
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " "))


def metadata_token(text: Column) -> Column:
    """As search_token, but underscores stay."""
    return F.trim(F.regexp_replace(folded(text), r"[^\p{L}\p{N}_]+", " "))


def label_key(text: Column) -> Column:
    """Folded text with its punctuation: labels that differ in case and accents only are one."""
    return F.trim(folded(text))


def spaced_label_key(text: Column) -> Column:
    """A label's key with white space as single spaces."""
    return F.trim(F.regexp_replace(folded(text), r"\s+", " "))


def comparison_text(text: Column) -> Column:
    """A text to compare wordings by: spaced_label_key without spaces before punctuation, and with one sign for degrees."""
    degrees = F.regexp_replace(text, "\\s*[\u00ba\u02da\u00b0]\\s*", "\u00b0")
    return F.regexp_replace(spaced_label_key(degrees), r" +([,.;:!?])", "$1")


def title_key(text: Column) -> Column:
    """One form for Greek, Latin and mixed spellings of a title; rules never cross a space."""
    key = search_token(text)
    for a, b in GREEK_DIGRAPHS:
        key = F.replace(key, F.lit(a), F.lit(b))
    key = F.translate(key, GREEK_LETTERS, LATIN_LETTERS)
    for a, b in GREEK_DOUBLES + LATIN_SOUNDS:
        key = F.replace(key, F.lit(a), F.lit(b))
    return F.regexp_replace(key, r"(\p{L})\1+", "$1")


def exact_search_token(text: str | None) -> str:
    """What search_token stands for, by full decomposition: the form to test against."""
    plain = unicodedata.normalize("NFKD", text or "").casefold()
    kept = "".join(c for c in plain if unicodedata.category(c) != "Mn").replace("ς", "σ")
    return " ".join("".join(c if c.isalnum() else " " for c in kept).split())


@F.pandas_udf(StringType())
def exact_search_token_udf(text: pd.Series) -> pd.Series:
    """exact_search_token in Arrow batches, for text beyond the table of marked letters."""
    return text.map(exact_search_token)


def words(text: Column) -> Column:
    """Tokens of a key, none for an empty one."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def contains_all(key: Column, terms: list[str]) -> Column:
    """Every term is somewhere in the key. Terms are literals, never patterns."""
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(key, F.lit(t))
    return out


def contains_words(key: Column, terms: list[str]) -> Column:
    """Every term is a whole word of the key."""
    return contains_all(F.concat(F.lit(" "), key, F.lit(" ")), [f" {t} " for t in terms])


def starts_words(key: Column, terms: list[str]) -> Column:
    """Every term begins a word of the key."""
    return contains_all(F.concat(F.lit(" "), key), [f" {t}" for t in terms])


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: inside a lambda an expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def neighbourhood(tokens: Column, reach: int = 3) -> Column:
    """For each token: its place, the one before it, and those up to `reach` places away."""
    return bound(
        tokens,
        lambda all_: F.transform(
            all_,
            lambda t, i: F.struct(
                i.alias("place"),
                t.alias("token"),
                F.when(i > 0, F.get(all_, i - 1)).alias("previous"),
                F.slice(all_, F.greatest(i - reach + 1, F.lit(1)), reach + 1 + F.least(i, F.lit(reach))).alias("near"),
            ),
        ),
    )


def ordered_distinct(values: Column, key) -> Column:
    """The first of the values of each key, in order."""
    empty = F.filter(F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v"))), lambda x: F.lit(False))
    keyed = F.transform(values, lambda v: F.struct(key(v).alias("k"), v.alias("v")))
    kept = F.aggregate(keyed, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x["v"])

"""Parsers of durations, quantities, ratings, identifiers and addresses. Bad input gives the stated default, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d+(?:[.,]\d+)?"
# Minutes in the units of durations, before and after the T; and words for units of time.
ISO_MINUTES = [1440.0, 60.0, 1.0, 1 / 60]  # D, and H, M, S after the T
TIME_WORDS = {"day": (1440, r"days?|ημέρ[εα]ς?"), "hour": (60, r"hours?|ώρ[εα]ς?"), "minute": (1, r"minutes?|min|λεπτά?")}
# Signs that are one fraction, and words for measures.
GLYPHS = "¼½¾⅓⅔⅛⅜⅝⅞"
MEASURES = ("kg", "gr?", "ml", "lt?", "tbsp", "tsp", "cups?", "κιλ[όά]", "γρ(?:αμμάρι(?:α|ο)?)?", "κ\\.\\s?[σγ]", "φλ(?:ιτζάνι(?:α)?)?", "λίτρ(?:ο|α)", "κουταλ(?:ιά|ιές|άκι|άκια)")
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"


def rating_doubled(value: Column, largest: Column) -> Column:
    """A rating on a scale of five (its largest is 5 or less) doubled, others as they are; within 0 and 10, two decimals."""
    fine = value.isNotNull() & ~F.isnan(value)
    return F.coalesce(F.when(fine, F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.when(largest <= 5, value * 2).otherwise(value))), 2)), F.lit(0.0))


def _number(text: Column) -> Column:
    return F.coalesce(F.replace(text, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


_ISO = r"^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?\z"


def iso_minutes(text: Column) -> Column:
    """Minutes of an ISO 8601 duration, rounded up; null where it isn't one. What stands before the T are days, what stands after it times of day, each unit once at most and in order."""
    upper = F.upper(text)
    days, *times = (_number(F.regexp_extract(upper, _ISO, k)) * worth for k, worth in enumerate(ISO_MINUTES, 1))
    return F.when(upper.rlike(_ISO) & upper.rlike("[0-9]"), F.ceil(days + sum(times[1:], times[0])))


def wait_minutes(text: Column) -> Column:
    """Minutes that a free text tells, numbers with their units added up; else its last number; else 0."""
    wait = rf"(?iu)({NUMBER})\s*({'|'.join(words for _, words in TIME_WORDS.values())})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(wait), 1).alias("n"), F.regexp_extract_all(text, F.lit(wait), 2).alias("u"))

    def worth(unit: Column) -> Column:
        out = F.lit(None).cast("int")
        for minutes, words in TIME_WORDS.values():
            out = F.coalesce(out, F.when(unit.rlike(rf"(?iu)^(?:{words})$"), minutes))
        return out

    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + _number(p["n"]) * worth(p["u"]))
    numbers = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)
    return F.ceil(F.when(F.size(pairs) > 0, total).when(F.size(numbers) > 0, _number(F.element_at(numbers, -1))).otherwise(0.0))


def total_minutes(explicit: Column, *parts: Column) -> Column:
    """The explicit total; else the sum of the known parts; else null."""
    known = F.lit(0)
    for p in parts:
        known = known + F.coalesce(p, F.lit(0))
    return F.coalesce(explicit, F.when(F.coalesce(*parts).isNotNull(), known))


def rating_of_ten(value: Column, best: Column) -> Column:
    """value / best * 10, within 0 and 10, two decimals; 0 where either is missing or no number."""
    fine = value.isNotNull() & best.isNotNull() & ~F.isnan(value) & ~F.isnan(best) & (best > 0)
    return F.coalesce(F.when(fine, F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), value / best * 10)), 2)), F.lit(0.0))


def _amount() -> str:
    """A pattern of what can be an amount, longer forms before the shorter ones that they begin with."""
    whole, glyph = r"\d+", f"[{GLYPHS}]"
    fraction = rf"{whole}\s*/\s*{whole}"
    forms = [rf"{whole}\s*{glyph}", rf"{whole}\s+{fraction}", fraction, rf"{NUMBER}\s*[-–]\s*{NUMBER}", NUMBER, glyph]
    return f"(?:{'|'.join(forms)})"


def measured(line: Column) -> Column:
    """struct(quantity, unit, title, info) of a line such as '2 cups flour, sifted'.

    A line is read in steps, each of which takes what it knows off the front: an amount, then a measure that something
    follows. What is left is the title up to its first comma, and the rest is info. A line stays whole where nothing
    follows the amount, where a measure alone does, or where it is a multiple such as '2 x 400 g'.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "))
    amount = F.regexp_extract(clean, f"^{_amount()}", 0)
    after = F.ltrim(F.substr(clean, F.length(amount) + 1))
    unit = F.regexp_extract(after, rf"(?iu)^({'|'.join(MEASURES)})(?![\p{{L}}\p{{N}}])", 1)
    behind = F.ltrim(F.regexp_replace(F.substr(after, F.length(unit) + 1), r"^\.", ""))
    whole = (amount == "") | (after == "") | after.rlike(r"(?i)^[x×]\s*\d") | ((unit != "") & (behind == ""))
    title = F.when(whole, clean).when(unit != "", behind).otherwise(after)
    comma = F.instr(title, ",")
    head, tail = F.trim(F.substr(title, F.lit(1), comma - 1)), F.trim(F.substr(title, comma + 1))
    noted = (comma > 0) & (head != "") & (tail != "")
    return F.struct(
        F.when(whole, "").otherwise(amount).alias("quantity"),
        F.when(whole, "").otherwise(unit).alias("unit"),
        F.when(noted, head).otherwise(title).alias("title"),
        F.when(noted, tail).otherwise("").alias("info"),
    )


def strict_minutes(text: Column) -> Column:
    """Minutes of a text that is durations and nothing else (of a range, the larger end); 0 for any other."""
    one = r"(?i)(?:\d+\s*[-–]\s*)?(\d+)\s*(hours?|h|minutes?|min|m)\b"
    left = F.trim(F.regexp_replace(text, one + r"[\s,]*", ""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(one), 1).alias("n"), F.regexp_extract_all(text, F.lit(one), 2).alias("u"))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + _number(p["n"]) * F.when(F.lower(p["u"]).startswith("h"), 60).otherwise(1))
    return F.when(left == "", F.ceil(total)).otherwise(0)


def safe_number(text: Column, default: float = 0.0) -> Column:
    """A number that may have a decimal comma; negative ones are 0, others that can't be read the default."""
    value = F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")
    return F.greatest(F.lit(0.0), F.when(value.isNull() | F.isnan(value), F.lit(default)).otherwise(value))


def stable_key(text: Column) -> Column:
    """A number in [0, 1) that a text always has: the first 8 bytes of its SHA-256."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(2.0**64)


def stable_head(text: Column) -> Column:
    """The first 32 bits of the hash behind stable_key. A double rounds the key's 64 bits, which may carry into these."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def namespaced(provider: Column, id_: Column) -> Column:
    """An id of a provider as one text, so that equal ids of two providers differ."""
    return F.concat(provider, F.lit(":"), id_)


def namespaced_key(provider: Column, id_: Column) -> Column:
    """stable_key of an id of a provider."""
    return stable_key(namespaced(provider, id_))


def document_id(source: Column, native: Column) -> Column:
    """Digits stay as they are; a safe native id gets its source's key; any other is hashed."""
    return F.when(native.rlike(r"^\d+$"), native).when(native.rlike(SAFE_ID), F.concat(source, F.lit("_"), native)).otherwise(F.concat(source, F.lit("_h_"), F.sha2(native, 256)))


def event_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def canonical_url(url: Column, hosts: tuple[str, ...] | None = None, path: str | None = None) -> Column:
    """https://host/path in lower-case host without www, query, fragment and trailing slash. Null where the address isn't https, has credentials or a port, or where its host isn't one of `hosts` or its path (without the trailing slash) not of the pattern `path` (None: any)."""
    form = r"(?i)^https://([^/?#]+)(/[^?#]*)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, form, 1)), r"^www\.", "")
    own = F.regexp_replace(F.regexp_extract(url, form, 2), "/+$", "")
    known = host.isin(*hosts) if hosts is not None else F.lit(True)
    fits = own.rlike(path) if path is not None else F.lit(True)
    return F.when((host != "") & ~host.rlike("[@:]") & known & fits, F.concat(F.lit("https://"), host, own))


def url_id(url: Column, path: str) -> Column:
    """The id in an address: the first group of its path's pattern; null where that doesn't fit."""
    own = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]+(/[^?#]*)?", 1), "/+$", "")
    return F.when(own.rlike(path), F.nullif(F.regexp_extract(own, path, 1), F.lit("")))


def strict_month(text: Column) -> Column:
    """The first day of the month that yyyy-MM or yyyy-MM-dd says, of the years 1900 to 2100 and a day that there is; null for any other text."""
    form = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    day = F.try_to_timestamp(form, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(day).between(1900, 2100), F.trunc(day, "MM"))


def page_key(url: Column) -> Column:
    """host/path of any web address, to tell pages apart: without scheme, www, credentials, port, query, fragment and trailing slash; null where it is none."""
    form = r"(?i)^https?://(?:[^/@?#]*@)?([^/:?#]+)(?::\d+)?(/[^?#]*)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, form, 1)), r"^www\.", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(F.regexp_extract(url, form, 2), "/+$", "")))


def epoch_millis(text: Column) -> Column:
    """Milliseconds of a timestamp with an offset; 0 for any other text."""
    stamp = F.try_to_timestamp(text)
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & stamp.isNotNull(), F.unix_millis(stamp)).otherwise(F.lit(0)).cast("long")


def monotone(now: Column, previous: Column, least: int = 1, most: int = 253402300799999) -> Column:
    """A time after the previous one, within bounds."""
    return F.least(F.greatest(now, F.coalesce(previous, F.lit(0)) + 1, F.lit(least)), F.lit(most))


def minutes_label(minutes: Column) -> Column:
    """'1 h 20 min'; empty for none."""
    h, m = F.floor(minutes / 60), minutes % 60
    return F.when(F.coalesce(minutes, F.lit(0)) <= 0, "").when(h == 0, F.concat(m, F.lit(" min"))).when(m == 0, F.concat(h, F.lit(" h"))).otherwise(F.concat(h, F.lit(" h "), m, F.lit(" min")))


def amount_label(quantity: Column, unit: Column) -> Column:
    """'2 cups'; what is blank is left out."""
    return F.trim(F.concat_ws(" ", F.nullif(F.trim(quantity), F.lit("")), F.nullif(F.trim(unit), F.lit(""))))


def shortened(text: Column, most: int) -> Column:
    """At most `most` characters, cut at a word's end."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_extract(F.substring(text, 1, most), r"^(.*)\s\S*$", 1), F.lit("…")))


def ease(preparations: Column, steps: Column) -> Column:
    """A band of effort from how much is prepared and how many steps there are."""
    p, s = F.greatest(F.coalesce(preparations, F.lit(0)), F.lit(0)), F.greatest(F.coalesce(steps, F.lit(0)), F.lit(0))
    return F.when((p == 0) & (s == 0), "unknown").when((p >= 3) | (s >= 10), "involved").when((p <= 1) & s.between(1, 5), "easy").otherwise("moderate")


def quick(minutes: Column) -> Column:
    """Known, and under half an hour."""
    return F.coalesce((minutes > 0) & (minutes < 30), F.lit(False))

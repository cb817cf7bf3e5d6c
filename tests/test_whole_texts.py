"""Text functions over all texts of both tables, against brute force."""

import math
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import parse as pa
from quern.plans import texts
from quern.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"
UNITS = r"(days?|ημέρ[εα]ς?|hours?|ώρ[εα]ς?|minutes?|min|λεπτά?)"


@pytest.fixture(scope="module")
def rows(spark):
    return {(r["source"], r["id"], r["turn"]): r["text"] for r in texts.all_texts(lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")).collect()}


def got(spark, name):
    return {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES[name](spark, DATA).collect()}


def number(text):
    return float(text.replace(",", "."))


def wait(text):
    found = re.findall(r"([0-9]+(?:[.,][0-9]+)?)[ \t\n\r\f\v]*" + UNITS, text, re.I)
    if found:
        return math.ceil(sum(number(n) * (1440 if u.lower().startswith(("day", "ημέρ")) else 60 if u.lower().startswith(("hour", "ώρ")) else 1) for n, u in found))
    last = re.findall(r"[0-9]+(?:[.,][0-9]+)?", text)
    return math.ceil(number(last[-1])) if last else 0


def test_waits(spark, rows):
    out = got(spark, "text_waits")
    assert out.keys() == rows.keys() and len(rows) > 200
    assert out == {k: (min(wait(t), 2**63 - 1),) for k, t in rows.items()}


def test_strict_minutes(spark, rows):
    one = r"(?:[0-9]+\s*[-–]\s*)?([0-9]+)\s*(hours?|h|minutes?|min|m)\b"
    flags = re.I | re.A
    want = {k: (0 if re.sub(one + r"[\s,]*", "", t, flags=flags).strip(" ") else sum(int(n) * (60 if u[0] in "hH" else 1) for n, u in re.findall(one, t, flags)),) for k, t in rows.items()}
    assert {k: v for k, v in got(spark, "text_strict_minutes").items() if k[0] != "part"} == want  # those made from part have their SQL


def test_timing(spark, rows):
    flags = re.I | re.A
    action = r"\b(?:leave|place|bake|boil|simmer|cook|rest|marinate|soak|chill|freeze|wait)\b"
    optional = r"\b(?:if|can|may|optional\w*|alternatively|ideally|keeps?|store)\b"
    duration = r"([0-9]+(?:[.,][0-9]+)?)\s*(?:(?:-|–|to)\s*[0-9]+(?:[.,][0-9]+)?\s*)?(days?|hours?|minutes?|min)\b"

    def n(k, t):
        total = k[1] % 90
        if not total:
            return 0
        out = 0
        for s in re.split(r"(?<=[.!?;])\s+|\n+", t, flags=re.A):
            longer = any(number(a) * {"d": 1440, "h": 60}.get(u[0].lower(), 1) > total for a, u in re.findall(duration, s, flags)) or total < 30 and re.search(r"\b(?:overnight|all night|until the next day)\b", s, flags)
            out += bool(re.search(action, s, flags) and not re.search(optional, s, flags) and longer)
        return out

    assert got(spark, "text_timing") == {k: (n(k, t),) for k, t in rows.items()}


def test_every_text_and_line_is_there(spark, rows):
    assert got(spark, "text_clauses").keys() == rows.keys()
    lines = [tuple(r)[:4] for r in QUERIES["text_quantities"](spark, DATA).select("source", "id", "turn", "line").collect()]
    assert sorted(lines) == sorted((*k, i) for k, t in rows.items() for i in range(t.count("\n") + 1))


def test_large_numbers_are_no_errors(spark):
    rows = spark.createDataFrame([("99999999999 min", "P9999999D")], "text string, iso string")
    got = rows.select(pa.wait_minutes(F.col("text")), pa.strict_minutes(F.col("text")), pa.iso_minutes(F.col("iso"))).first()
    assert tuple(got) == (99999999999, 99999999999, 9999999 * 1440)

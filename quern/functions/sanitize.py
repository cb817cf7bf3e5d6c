"""JSON texts made safe to store: bounded depth, whole numbers of 64 bits, finite numbers, keys that are unique and not blank."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DEEPEST = 32


def sanitized(text: str | None, deepest: int = DEEPEST) -> str | None:
    """Canonical JSON (keys in order, compact) of a text that keeps the rules; null for any other."""

    def pairs(found: list[tuple[str, object]]) -> dict:
        out = dict(found)
        if len(out) < len(found) or not all(k.strip() for k in out):
            raise ValueError("keys")
        return out

    def check(value, depth: int) -> None:
        if depth > deepest:
            raise ValueError("depth")
        if isinstance(value, bool) or value is None:
            return
        if isinstance(value, int) and not -(1 << 63) <= value < 1 << 63 or isinstance(value, float) and not math.isfinite(value):
            raise ValueError("number")
        for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            check(x, depth + 1)

    try:
        value = json.loads(text, object_pairs_hook=pairs)
        check(value, 0)
        return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def sanitized_json(text: pd.Series) -> pd.Series:
    return text.map(sanitized)

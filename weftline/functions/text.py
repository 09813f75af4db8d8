"""Text normalisers and similarities as columns; Jaro-Winkler alone needs an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, without letter case; 1 for two empty texts, 0 for one."""
    la, lb = F.lower(a), F.lower(b)
    n = F.greatest(F.length(la), F.length(lb))
    return F.when(n == 0, 1.0).when(F.least(F.length(la), F.length(lb)) == 0, 0.0).otherwise(1 - F.levenshtein(la, lb) / n)


def phone(c: Column) -> Column:
    """Digits with country code: ten digits get +91, leading zeros before more than ten digits go."""
    kept = F.regexp_replace(c, r"[^0-9+]", "")
    plus = F.startswith(kept, F.lit("+"))
    digits = F.regexp_replace(F.when(plus, F.substr(kept, F.lit(2))).otherwise(kept), r"^0+(?=[0-9]{10})", "")
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "")
        .when(digits.rlike("^91[0-9]{10}$"), F.concat(F.lit("+"), digits))
        .when(F.length(digits) == 10, F.concat(F.lit("+91"), digits))
        .when(plus, kept)
        .when(digits != "", F.concat(F.lit("+"), digits))
        .otherwise(F.trim(c))
    )


def plate(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-.]", ""))


def account(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-./]", ""))


def same_phone(a: Column, b: Column) -> Column:
    """Digits equal, or one the end of the other, with ten digits at least on both sides."""
    da, db = F.regexp_replace(a, r"[^0-9]", ""), F.regexp_replace(b, r"[^0-9]", "")
    return (F.length(da) >= 10) & (F.length(db) >= 10) & (F.endswith(da, db) | F.endswith(db, da))


def jaro(a: str, b: str) -> float:
    """Jaro similarity without letter case; transpositions count by halves."""
    if a == b:
        return 1.0
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit_b[j] and b[j] == ch:
                hit_a[i] = hit_b[j] = True
                break
    xs, ys = [c for c, h in zip(a, hit_a) if h], [c for c, h in zip(b, hit_b) if h]
    if not xs:
        return 0.0
    m, t = len(xs), sum(x != y for x, y in zip(xs, ys)) / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def winkler(a: str, b: str, scale: float = 0.1, most: int = 4, least: float = 0.7) -> float:
    """Jaro with a bonus for a common beginning, from ``least`` on."""
    s = jaro(a, b)
    if s < least:
        return s
    k = 0
    for x, y in zip(a.lower()[:most], b.lower()[:most]):
        if x != y:
            break
        k += 1
    return s + k * scale * (1 - s)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else winkler(x, y) for x, y in zip(a, b)], dtype="float64")


_TITLES = r"^(?i:(?:mr|mrs|ms|dr|shri|smt)\.?\s+)+"


def _name(a: str, b: str) -> float:
    import re

    a, b = re.sub(_TITLES, "", a.strip()), re.sub(_TITLES, "", b.strip())
    if a.lower() == b.lower():
        return 1.0
    x, y = a.lower().split(), b.lower().split()
    free = list(y)
    shared = 0
    for t in x:
        m = next((u for u in free if u == t or winkler(t, u) >= 0.92), None)
        if m is not None:
            free.remove(m)
            shared += 1
    total = len(x) + len(y) - shared
    best = max(shared / total if total else 0.0, winkler(a, b))
    if len(x) > 1 and len(y) > 1 and x[-1] == y[-1]:
        f, g = x[0].rstrip("."), y[0].rstrip(".")
        if f and g and f[0] == g[0] and min(len(f), len(g)) == 1:
            best = max(best, 0.88)
    return best


@F.pandas_udf(DoubleType())
def person_name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token overlap or Jaro-Winkler, whichever is more; an initial with an equal family name gives 0.88."""
    return pd.Series([None if x is None or y is None else _name(x, y) for x, y in zip(a, b)], dtype="float64")

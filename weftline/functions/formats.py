"""How times, case numbers and lists are written; dictionary translation; all as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed(us: Column) -> Column:
    """``+Nd Nh``, ``+Nh Nm`` or ``+Nm`` (one minute at least)."""
    m = F.floor(us / 60_000_000)
    d, h = F.floor(m / 1440), F.floor(m / 60)
    text = lambda c: c.cast("string")
    return (
        F.when(d >= 1, F.concat(F.lit("+"), text(d), F.lit("d "), text(h % 24), F.lit("h")))
        .when(h >= 1, F.concat(F.lit("+"), text(h), F.lit("h "), text(m % 60), F.lit("m")))
        .otherwise(F.concat(F.lit("+"), text(F.greatest(m, F.lit(1))), F.lit("m")))
    )


def at_precision(ts: Column, precision: Column) -> Column:
    """A time as precisely as it is known."""
    p = F.upper(precision)
    return (
        F.when(ts.isNull() | (p == "UNKNOWN"), "Time unavailable")
        .when(p.isin("DAY", "DATE_ONLY"), F.date_format(ts, "yyyy-MM-dd"))
        .when(p == "MONTH", F.date_format(ts, "yyyy-MM"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm"))
    )


def case_number(prefix: str, district: Column, year: Column, seq: Column) -> Column:
    """``<prefix>-<three letters>-<year>-<sequence of four digits>``."""
    return F.concat_ws("-", F.lit(prefix), F.upper(F.left(F.regexp_replace(district, "[^A-Za-z]", ""), F.lit(3))), year.cast("string"), F.lpad(seq.cast("string"), 4, "0"))


def json_list(text: Column) -> Column:
    """A JSON list of texts; bad JSON and null are the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.expr("cast(array() as array<string>)"))


def has_devanagari(text: Column) -> Column:
    return text.rlike("[\\u0900-\\u097F]")


def translate(text: Column, terms: list[tuple[str, str]], to_devanagari: bool) -> Column:
    """Whole-word replacements in order, without letter case; text already in the wanted script stays."""
    out = text
    for a, b in terms:
        out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{M}}]){re.escape(a)}(?![\p{{L}}\p{{M}}])", b.replace("$", "\\$"))
    done = has_devanagari(text) if to_devanagari else ~has_devanagari(text)
    return F.when(done, text).otherwise(out)

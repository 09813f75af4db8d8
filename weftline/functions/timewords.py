"""Time expressions of case texts as UTC bounds and a precision, without zones or offsets.

This is the plain reading beside the zone-aware one of ``instants``: what a text writes is taken as UTC, an
offset is passed over, and vague expressions give bounds instead of an instant. Rules are tried in a fixed
order; a rule whose first match is no valid time passes to the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months by name (fixed values).
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
#: First and last hour of the parts of a day (fixed values).
DAY_PARTS = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 22), "night": (22, 23), "dawn": (4, 7), "dusk": (17, 20)}
#: Numbers in words (fixed values).
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
#: Expressions by rule (fixed values).
ISO = r"(?i)\b(\d{4})-(\d{2})-(\d{2})[T\s](\d{2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
TIME_RANGE = r"(?i)\b(?:between\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(?:to|–|-|and)\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\b"
DATE_TIME = r"(?i)\b(\d{1,2})[/\-\s]([A-Za-z]+|\d{1,2})[/\-\s](\d{4})\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?\b"
DAY_MONTH_YEAR = r"(?i)\b(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b"
NUMERIC_DAY = r"\b(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})\b"
NUMERIC_YEAR = r"\b(\d{4})-(\d{2})-(\d{2})\b"
DATE_RANGE = r"(?i)\b(?:between\s+)?(\d{1,2})\s*(?:and|to|–|-)\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b"
MONTH_YEAR = r"\b([A-Za-z]+|\d{1,2})[/\s](\d{4})\b"
DAY_PART = r"(?i)\b(morning|afternoon|evening|night|dawn|dusk)\s+of\s+(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\b"
DAYS_LATER = r"(?i)\b(?:(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+days?\s+(?:later|after|following))\b"


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(key))


def _at(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """A timestamp without zone; null where there is no such time."""
    n = lambda c: c.try_cast("int")
    made = F.call_function("try_make_timestamp_ntz", n(y), n(mo), n(d), n(h), n(mi), n(s))
    return F.when((n(y) > 0) & (n(h) < 24) & (n(mi) < 60) & (n(s) < 60), made)


def _result(start: Column, end: Column, precision: Column | str, approximate: bool, confidence: float) -> Column:
    precision = F.lit(precision) if isinstance(precision, str) else precision
    whole = F.struct(start.alias("s"), end.alias("e"), precision.alias("time_precision"), F.lit(approximate).alias("is_approximate"), F.lit(confidence).alias("confidence"))
    return F.when(start.isNotNull() & end.isNotNull(), whole)


def time_expression(text: Column, reference: Column) -> Column:
    """struct(start_time_utc, end_time_utc, time_precision, is_approximate, confidence) of a text.

    ``reference`` is the date (timestamp or null) that clock ranges and counts of days refer to; without one a
    clock range has no start here, and a count of days is APPROXIMATE. Null, blank and unread texts are UNKNOWN.
    """
    t = F.trim(text)
    g = lambda p, k: F.regexp_extract(t, p, k)
    zero, top, last = F.lit(0), F.lit(23), F.lit(59)
    month = lambda c: F.coalesce(_lookup(MONTHS, c), F.when(c.rlike("^[0-9]+$"), c.try_cast("int")))

    def clock(p: str, date: tuple[Column, Column, Column], h: int, confidence: float) -> Column:
        sec = g(p, h + 2)
        at = _at(*date, g(p, h), g(p, h + 1), F.when(sec != "", sec).otherwise("0"))
        return _result(at, at, F.when(sec != "", "EXACT").otherwise("MINUTE"), False, confidence)

    def day(y: Column, m: Column, d: Column, confidence: float, precision: str = "DATE_ONLY", d2: Column | None = None) -> Column:
        return _result(_at(y, m, d, zero, zero, zero), _at(y, m, d if d2 is None else d2, top, last, last), precision, False, confidence)

    part_month = month(g(DAY_PART, 3))
    hours = [_lookup({k: v[i] for k, v in DAY_PARTS.items()}, g(DAY_PART, 1)) for i in (0, 1)]
    part = _result(*[_at(g(DAY_PART, 4), part_month, g(DAY_PART, 2), h, zero, zero) for h in hours], "HOUR", True, 0.85)
    ref = [F.year(reference), F.month(reference), F.day(reference)]
    span = _result(_at(*ref, g(TIME_RANGE, 1), g(TIME_RANGE, 2), zero), _at(*ref, g(TIME_RANGE, 4), g(TIME_RANGE, 5), zero), "MINUTE", False, 0.92)
    first = _at(g(MONTH_YEAR, 2), month(g(MONTH_YEAR, 1)), F.lit(1), zero, zero, zero)
    whole_month = _result(first, first + F.expr("interval 1 month") - F.expr("interval 1 second"), "MONTH", False, 0.88)
    count = F.coalesce(_lookup(NUMBERS, g(DAYS_LATER, 1)), F.when(g(DAYS_LATER, 1).rlike("^[0-9]{1,6}$"), g(DAYS_LATER, 1).try_cast("int")))
    to = F.date_add(reference.cast("date"), F.when(count > 0, count))
    later = _result(to.cast("timestamp_ntz"), to.cast("timestamp_ntz") + F.expr("interval 86399 second"), "DAY", True, 0.80)
    nothing = F.lit(None).cast("timestamp_ntz")
    vague = F.struct(nothing.alias("s"), nothing.alias("e"), F.lit("APPROXIMATE").alias("time_precision"), F.lit(True).alias("is_approximate"), F.lit(0.50).alias("confidence"))
    unknown = F.struct(nothing.alias("s"), nothing.alias("e"), F.lit("UNKNOWN").alias("time_precision"), F.lit(False).alias("is_approximate"), F.lit(0.0).alias("confidence"))
    words = lambda p, k: _lookup(MONTHS, g(p, k))
    rules = [
        clock(ISO, (g(ISO, 1), g(ISO, 2), g(ISO, 3)), 4, 0.99),
        part,
        day(g(DATE_RANGE, 4), words(DATE_RANGE, 3), g(DATE_RANGE, 1), 0.90, "DAY", g(DATE_RANGE, 2)),
        clock(DATE_TIME, (g(DATE_TIME, 3), month(g(DATE_TIME, 2)), g(DATE_TIME, 1)), 4, 0.95),
        span,
        day(g(DAY_MONTH_YEAR, 3), words(DAY_MONTH_YEAR, 2), g(DAY_MONTH_YEAR, 1), 0.95),
        day(g(NUMERIC_YEAR, 1), g(NUMERIC_YEAR, 2), g(NUMERIC_YEAR, 3), 0.95),
        day(g(NUMERIC_DAY, 3), g(NUMERIC_DAY, 2), g(NUMERIC_DAY, 1), 0.92),
        whole_month,
        later,
        F.when(t.rlike(DAYS_LATER), vague),
    ]
    said = F.coalesce(*rules, unknown)
    iso = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.struct(iso(said.s).alias("start_time_utc"), iso(said.e).alias("end_time_utc"), said.time_precision.alias("time_precision"), said.is_approximate.alias("is_approximate"), said.confidence.alias("confidence"))

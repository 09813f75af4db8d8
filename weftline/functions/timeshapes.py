"""Moments in free text: shape masks, one parser for each distinct mask, vectorised reading.

A text becomes a list of tokens and a mask with one character a token (its character class), so
that a place in the mask is a place in the token list. A parser is found once for each distinct
mask by matching the shapes below against it; it names the token that holds each field. All
texts of one mask are then read together with numpy.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd

from weftline.functions.zones import ZoneTable

MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty"
).split()
#: Zone abbreviations and their offsets in minutes (fixed values; IST is Indian time here).
ABBREVIATIONS = {
    "ist": 330, "gst": 240, "bst": 60, "wet": 0, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "aest": 600, "aedt": 660, "acst": 570, "acdt": 630, "awst": 480, "jst": 540, "nzst": 720, "nzdt": 780, "sgt": 480, "pkt": 300,
}
_MONTH_NO = {m[:n]: i + 1 for i, m in enumerate(MONTHS) for n in (3, len(m))} | {"sept": 9}
_CLASS = (
    dict.fromkeys(_MONTH_NO, "M")
    | {w[:n]: "W" for w in WEEKDAYS for n in (3, len(w))}
    | {"tues": "W", "thur": "W", "thurs": "W", "am": "P", "pm": "P", "utc": "U", "gmt": "U", "t": "T", "z": "Z"}
    | dict.fromkeys(ABBREVIATIONS, "A")
    | dict.fromkeys(NUMBERS, "N")
    | {"hrs": "H", "hours": "H", "hr": "H", "h": "H", "at": "@", "on": "@", "between": "B", "from": "B", "and": "&", "to": "~", "till": "~", "until": "~"}
    | {"of": "o", "st": "s", "nd": "s", "rd": "s", "th": "s", "day": "d", "days": "d", "later": "l", "after": "f", "that": "h", "afterwards": "l"}
    | dict.fromkeys("morning afternoon evening night noon midnight dawn dusk".split(), "D")
    | {"epoch": "e", "ts": "e", "ts_ms": "e"}
)
_TOKEN = re.compile(r"\d+|ts_ms|[^\W\d_]+|\s+|.", re.S)
_DIGITS = {1: "1", 2: "2", 3: "3", 4: "4", 5: "5", 6: "6", 7: "7", 8: "8", 9: "9", 10: "E", 13: "K", 16: "Q", 19: "R"}
_PUNCT = {"–": "-", "—": "-", "−": "-", "‐": "-", "‑": "-"}


def tokens_of(text: str) -> tuple[list[str], str]:
    """The tokens, in lower case, and their mask."""
    toks = _TOKEN.findall(text.lower().strip())
    mask = []
    for t in toks:
        if t.isdecimal():
            mask.append(_DIGITS.get(len(t), "0"))
        elif t.isspace():
            mask.append(" ")
        elif t[0].isalpha():
            mask.append(_CLASS.get(t, "x"))
        else:
            t = _PUNCT.get(t, t)
            mask.append(t if t in "-:/.,+=" else "?")
    return toks, "".join(mask)


_N = "[0-9EKQR]"
_OFF = r"(?:(?P<sign>[+-])(?P<oh>[12])(?::(?P<om>2))?|(?P<osign>[+-])(?P<o4>4)|(?P<utc>[ZU])|(?P<abbr>A)|U(?P<usign>[+-])(?P<uh>[12])(?::(?P<um>2))?)"
_OFF = _OFF.replace("(?P<utc>[ZU])", "(?P<utc>[ZU])(?![+-][12])")
_CLOCK = r"(?P<h>[12]):(?P<mi>2)(?::(?P<s>2)(?:\.(?P<fr>" + _N + r"))?)?(?: ?(?P<ap>P))?(?: ?" + _OFF + ")?"
_HHMM = r"(?P<hm>4) ?H(?: ?" + _OFF + ")?"
_DMY = r"(?P<d>[12])(?P<sep>[-/.])(?P<mo>[12])(?P=sep)(?P<y>[42])"
_YMD = r"(?P<y>4)(?P<sep>[-/.])(?P<mo>[12])(?P=sep)(?P<d>[12])"
_DMONY = r"(?P<d>[12])s?[ -]?(?:o )?(?P<mn>M)\.?,?[ -]?(?P<y>4)"
_DMONYY = r"(?P<d>[12])(?P<sep>[- ])(?P<mn>M)(?P=sep)(?P<y>2)"
_MOND = r"(?P<mn>M)\.? (?P<d>[12])s?,? (?P<y>4)"
_JOIN = r"(?:,? ?[@B] | ?, ?|T| )"
_L, _R = r"(?<![0-9EKQR:/+\-])", r"(?![0-9EKQR]|[:/\-+][0-9EKQR])"
#: Shapes in the order in which they are tried; the first that occurs anywhere in the mask wins.
SHAPES = [
    ("none", r"D o (?:" + "|".join((r"[12]s?[ -]?(?:o )?M", r"M [12]", r"[12][-/.][12]", r"4-")) + ")"),
    *[("moment", _L + date + _JOIN + _CLOCK) for date in (_YMD, _DMY, _DMONY, _MOND)],
    ("moment", _L + _DMONYY + _JOIN + _CLOCK),
    *[("moment", _L + date + _JOIN + _HHMM) for date in (_MOND, _DMONY, _YMD, _DMY)],
    *[("moment", _L + clock + r",? (?:@ )?" + date + _R) for clock in (_HHMM, _CLOCK) for date in (_DMY, _DMONY, _MOND, _YMD)],
    ("moment", _L + r"(?P<ymd>8)T?(?P<hms>6)" + "(?: ?" + _OFF + ")?"),
    ("moment", _L + r"(?P<d>[12])s? ?[-&~] ?[12]s? (?:o )?(?P<mn>M),? (?P<y>4)" + _R),
    *[("moment", _L + date + _R) for date in (_YMD, _DMONY, _MOND, _DMY)],
    ("moment", _L + r"(?P<mn>M)\.?,? (?P<y>4)" + _R),
    ("moment", _L + r"(?P<mo>[12])/(?P<y>4)" + _R),
    ("epoch", r"(?<![0-9EKQR+\-:/])(?P<ms>K)(?![0-9EKQR:/\-])"),
    ("epoch", r"(?<![0-9EKQR+\-:/])(?P<sec>E)(?![0-9EKQR:/\-])"),
    # of other widths only where nothing else is there or the text says that it is one
    *[("epoch", before + field + r"(?![0-9EKQR:/\-])" + after) for before, after in (("^", "$"), (r"e ?[:=]? ?", "")) for field in ("(?P<us>Q)", "(?P<ns>R)", "(?P<sec>9)")],
    ("relative", r"(?P<n>N|[12]) d (?:l|f h)"),
    ("clock", _L + r"(?P<h>[12]):(?P<mi>2)(?: ?(?P<ap>P))? ?[-~&] ?[12]:2"),  # a range, not an offset
    ("clock", _L + _CLOCK),
    ("clock", _L + _HHMM),
]
_COMPILED = [(kind, re.compile(shape)) for kind, shape in SHAPES]


@lru_cache(maxsize=100_000)
def parser_of(mask: str) -> tuple[str, tuple[tuple[str, int], ...]]:
    """(kind, the token of each field) for a mask; kind ``none`` where it names no moment."""
    for kind, shape in _COMPILED:
        m = shape.search(mask)
        if m:
            return kind, tuple((k, m.start(k)) for k, v in m.groupdict().items() if v is not None and k != "sep")
    return "none", ()


def _ints(col: list[str]) -> np.ndarray:
    return np.array([int(x) for x in col], dtype=np.int64)


def _days(y: np.ndarray, mo: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since 1970-01-01, whether the date exists)."""
    ok = (y >= 1) & (y <= 9999) & (mo >= 1) & (mo <= 12) & (d >= 1)
    y, mo = np.where(ok, y, 1970), np.where(ok, mo, 1)
    month = ((y - 1970) * 12 + mo - 1).astype("datetime64[M]")
    first = month.astype("datetime64[D]").astype(np.int64)
    ok &= first + d <= (month + 1).astype("datetime64[D]").astype(np.int64)
    return first + np.where(ok, d, 1) - 1, ok


def _read(kind: str, at: dict[str, int], toks: list[list[str]], ref_day: np.ndarray, has_ref: np.ndarray):
    """(local or UTC microseconds, offset in minutes or none, valid) of all texts with one parser."""
    n = len(toks)
    col = lambda k: [t[at[k]] for t in toks]
    num = lambda k: _ints(col(k))
    ok, off, known = np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    if kind == "epoch":
        us = num("ms") * 1_000 if "ms" in at else num("us") if "us" in at else num("ns") // 1_000 if "ns" in at else num("sec") * 1_000_000
        return us, off, ~known, ok
    if kind == "relative":
        words = [str(NUMBERS.index(w)) if w in NUMBERS else w for w in col("n")]
        return (ref_day + _ints(words)) * 86_400_000_000, off, known, has_ref
    if kind == "clock":
        day, ok = ref_day, has_ref.copy()
    elif "ymd" in at:
        ymd = num("ymd")
        day, ok = _days(ymd // 10_000, ymd // 100 % 100, ymd % 100)
    else:
        y = np.array([int(x) + (2000 if len(x) == 2 else 0) for x in col("y")], dtype=np.int64)
        mo = np.array([_MONTH_NO[x] for x in col("mn")], dtype=np.int64) if "mn" in at else num("mo")
        day, ok = _days(y, mo, num("d") if "d" in at else np.ones(n, dtype=np.int64))
    h = mi = s = us = np.zeros(n, dtype=np.int64)
    if "hm" in at:
        hm = num("hm")
        h, mi = hm // 100, hm % 100
    elif "hms" in at:
        hms = num("hms")
        h, mi, s = hms // 10_000, hms // 100 % 100, hms % 100
    elif "h" in at:
        h, mi = num("h"), num("mi")
        if "s" in at:
            s = num("s")
        if "fr" in at:
            us = _ints([x[:6].ljust(6, "0") for x in col("fr")])
    if "ap" in at:
        pm = np.array([x == "pm" for x in col("ap")])
        ok &= (h >= 1) & (h <= 12)
        h = h % 12 + np.where(pm, 12, 0)
    ok &= (h < 24) & (mi < 60) & (s < 60)
    for sign, hours, minutes in (("sign", "oh", "om"), ("usign", "uh", "um")):
        if hours in at:
            off = num(hours) * 60 + (num(minutes) if minutes in at else 0)
            off = np.where(np.array([x == "+" for x in col(sign)]), off, -off)
            known = ~known
    if "o4" in at:
        o = num("o4")
        off = (o // 100 * 60 + o % 100) * np.where(np.array([x == "+" for x in col("osign")]), 1, -1)
        known = ~known
    if "abbr" in at:
        off = np.array([ABBREVIATIONS[x] for x in col("abbr")], dtype=np.int64)
        known = ~known
    if "utc" in at:
        known = ~known
    return day * 86_400_000_000 + (h * 3600 + mi * 60 + s) * 1_000_000 + us, off, known, ok


_REF = re.compile(r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})")


@lru_cache(maxsize=100_000)
def reference_day(text) -> int | None:
    """Day number of a reference date: ISO first, else any date the shapes can read."""
    if not isinstance(text, str) or not text.strip():
        return None
    toks, mask = tokens_of(text)
    kind, at = parser_of(mask)
    none = np.zeros(1, dtype=np.int64)
    if kind == "moment":
        us, _, _, ok = _read(kind, dict(at), [toks], none, none.astype(bool))
        return int(us[0] // 86_400_000_000) if ok[0] else None
    if kind == "epoch":
        return int(_read(kind, dict(at), [toks], none, none.astype(bool))[0][0] // 86_400_000_000)
    return None


def to_utc(texts: pd.Series, zones: pd.Series, references: pd.Series, table: ZoneTable) -> pd.Series:
    """UTC microseconds that each text means; null where it means none or more than one."""
    out = pd.array([pd.NA] * len(texts), dtype="Int64")
    groups: dict[tuple, list[int]] = {}
    toks: list = [None] * len(texts)
    for i, t in enumerate(texts):
        if isinstance(t, str) and t.strip():
            toks[i], mask = tokens_of(t)
            groups.setdefault(parser_of(mask), []).append(i)
    days = [reference_day(r if isinstance(r, str) else None) for r in references]
    zone = [z.strip() if isinstance(z, str) and z.strip() else "" for z in zones]
    for (kind, at), rows in groups.items():
        if kind == "none":
            continue
        ref = np.array([days[i] or 0 for i in rows], dtype=np.int64)
        has = np.array([days[i] is not None for i in rows])
        us, off, known, ok = _read(kind, dict(at), [toks[i] for i in rows], ref, has)
        utc = us - off * 60_000_000
        for z in {zone[i] for i in rows} - {""}:
            mine = np.array([zone[i] == z for i in rows]) & ~known
            if not mine.any():
                continue
            if z not in table.zones:
                ok[mine] = False
                continue
            utc[mine], one = table.to_utc(z, us[mine])
            ok[mine] &= one
        for i, u, good in zip(rows, utc.tolist(), ok.tolist()):
            if good:
                out[i] = u
    return pd.Series(out)

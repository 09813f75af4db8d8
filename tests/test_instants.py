from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest

from weftline.functions.timeshapes import parser_of, to_utc, tokens_of
from weftline.functions.zones import ZoneTable, database_version
from weftline.operators.instants import normalise

ZONES = ["Asia/Kolkata", "America/New_York", "Europe/Berlin", "Europe/London", "Asia/Dubai", "Australia/Sydney"]
TABLE = ZoneTable.build(ZONES)


def us(*a, zone="UTC"):
    return int(datetime(*a, tzinfo=ZoneInfo(zone)).timestamp() * 1_000_000)


CASES = [
    ("1739655933123456", None, None, 1739655933_123456),
    ("epoch 1739655933123456789", "Asia/Dubai", None, 1739655933_123456),
    ("ts=999655933", None, None, 999655933_000000),
    ("1 Mar 24 10:00", None, None, us(2024, 3, 1, 10)),
    ("on 01-Mar-24 at 09:05 IST", None, None, us(2024, 3, 1, 3, 35)),
    ("seen 2025-05-23T20:15:36+00:00 ok", None, None, us(2025, 5, 23, 20, 15, 36)),
    ("2025-05-20T21:59:56.658209999Z", "Europe/London", None, us(2025, 5, 20, 21, 59, 56) + 658209),
    ("Wed, 19 Feb 2025 15:26:02 +0530", "Europe/London", None, us(2025, 2, 19, 9, 56, 2)),
    ("2025-12-27 02:05 IST", None, None, us(2025, 12, 26, 20, 35)),
    ("06-04-2025 02:50 UTC+11", None, None, us(2025, 4, 5, 15, 50)),
    ("20-06-2024 01:33 GMT+5:30", None, None, us(2024, 6, 19, 20, 3)),
    ("06-08-2024 21:14 UTC-4", None, None, us(2024, 8, 7, 1, 14)),
    ("20251119T184340Z", "Asia/Kolkata", None, us(2025, 11, 19, 18, 43, 40)),
    ("epoch 1739655933", "America/New_York", None, 1739655933_000000),
    ("ts_ms=1712603623123 (cam B)", "Asia/Kolkata", None, 1712603623_123000),
    ("ts=1746720256.", "Europe/London", None, 1746720256_000000),
    ("2203 hrs on 19/09/25", "America/New_York", None, us(2025, 9, 19, 22, 3, zone="America/New_York")),
    ("February 16, 2024 1413 hrs", "Australia/Sydney", None, us(2024, 2, 16, 14, 13, zone="Australia/Sydney")),
    ("27/10/2024 06:20", "America/New_York", None, us(2024, 10, 27, 6, 20, zone="America/New_York")),
    ("12 July 2024, 9:56AM", "Asia/Dubai", None, us(2024, 7, 12, 9, 56, zone="Asia/Dubai")),
    ("16 November 2024, 12:25 PM", None, None, us(2024, 11, 16, 12, 25)),
    ("7 Jan 2025, 12:43 AM IST", "Europe/Berlin", None, us(2025, 1, 6, 19, 13)),
    ("16 May 2024 between 04:45 and 05:45", None, None, us(2024, 5, 16, 4, 45)),
    ("28th of August 2024", "America/New_York", None, us(2024, 8, 28, zone="America/New_York")),
    ("February 17th, 2025", "Europe/Berlin", None, us(2025, 2, 17, zone="Europe/Berlin")),
    ("5 to 7 January 2024", "Asia/Kolkata", None, us(2024, 1, 5, zone="Asia/Kolkata")),
    ("between 6 - 8 October 2024", "Asia/Kolkata", None, us(2024, 10, 6, zone="Asia/Kolkata")),
    ("30-Dec-2025; no reply", "Asia/Kolkata", None, us(2025, 12, 30, zone="Asia/Kolkata")),
    ("16.03.2026", None, None, us(2026, 3, 16)),
    ("2026-02-13", None, None, us(2026, 2, 13)),
    ("during Dec 2025", None, None, us(2025, 12, 1)),
    ("09/2024 - gate", "Asia/Dubai", None, us(2024, 9, 1, zone="Asia/Dubai")),
    ("seven days later", "Europe/Berlin", "2024-10-20", us(2024, 10, 27, zone="Europe/Berlin")),
    ("12 days after that", None, "2024-02-26T00:00:00", us(2024, 3, 9)),
    ("07:17–08:17", "Asia/Kolkata", "2026-02-19", us(2026, 2, 19, 7, 17, zone="Asia/Kolkata")),
    ("18:10 to 19:10", None, "22/05/2024", us(2024, 5, 22, 18, 10)),
    ("ARRIVAL NOTED: OCTOBER 2025", None, None, us(2025, 10, 1)),
]
NONE = [
    ("night of 20 May 2026", "Asia/Kolkata", None), ("Caller logged plate ZZ 12 AB 3456", None, None), ("some time afterwards", None, "2024-01-01"), ("no time given", None, None),
    ("seven days later", None, None), ("18:10 to 19:10", None, None), ("31/02/2025", None, None), ("25:10 on 01/02/2025", None, "x"), ("serial 5512, room 12", None, None), ("account 1739655933123456 was frozen", None, None), ("ref 999655933", None, None),
    ("27/10/2024 02:41", "Europe/Berlin", None), ("31/03/2024 02:15", "Europe/Berlin", None), ("2024-05-05 10:00", "Mars/Base", None), ("", None, None), ("   ", None, None), (None, None, None),
]


def run(rows):
    t, z, r = zip(*rows)
    return to_utc(pd.Series(t, dtype=object), pd.Series(z, dtype=object), pd.Series(r, dtype=object), TABLE)


def test_notations():
    got = run([c[:3] for c in CASES])
    assert [(c[0], g) for c, g in zip(CASES, got)] == [(c[0], c[3]) for c in CASES]


def test_nothing_to_read():
    got = run(NONE)
    assert [(n[0], g) for n, g in zip(NONE, got) if not pd.isna(g)] == []


def test_folded_times_with_a_zone_are_clear():
    assert run([("27 Oct 2024, 2:12 AM CET", "Europe/Berlin", None)])[0] == us(2024, 10, 27, 1, 12)


def test_one_parser_for_each_mask():
    a, b = tokens_of("Seen 12 May 2024 at 10:11")[1], tokens_of("Gate 30 June 2025 at 23:59")[1]
    assert a == b and parser_of(a) is parser_of(b)


@pytest.mark.parametrize("zone", ZONES)
def test_zone_tables_against_zoneinfo(zone):
    rng = np.random.default_rng(1)
    sec = rng.integers(0, 4_000_000_000, 3000)
    sec = np.concatenate([sec, *(TABLE.zones[zone][0] + d for d in (-3600, -1800, -1, 0, 1, 1800, 3600))]) if len(TABLE.zones[zone][0]) else sec
    local = sec * 1_000_000
    got, one = TABLE.to_utc(zone, local)
    z = ZoneInfo(zone)
    for L, g, ok in zip(local.tolist(), got.tolist(), one.tolist()):
        naive = datetime(1970, 1, 1) + timedelta(microseconds=L)
        both = {int(naive.replace(tzinfo=z, fold=f).astimezone(timezone.utc).timestamp() * 1e6) for f in (0, 1)}
        real = {u for u in both if (datetime.fromtimestamp(u / 1e6, z)).replace(tzinfo=None) == naive}
        assert ok == (len(real) == 1)
        if ok:
            assert {g} == real
    assert database_version()


def test_operator(spark):
    rows = [(i, c[0], c[1], c[2], "x", 5) for i, c in enumerate(CASES)] + [(1000 + i, *n, "x", 5) for i, n in enumerate(NONE)] + [(None, "2024-01-01", None, None, "x", 5)]
    rows.append((2000, "word " * 50_000 + "2024-01-02", None, None, "x", 5))
    df = spark.createDataFrame(rows, "id bigint, t string, z string, r string, text string, key int")
    got = {r.id: r.utc_us for r in normalise(df, key="id", text="t", zone="z", reference="r").collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES)} | {2000: us(2024, 1, 2)}
    assert normalise(df.limit(0), key="id", text="t", zone="z", reference="r").count() == 0


def test_years_outside_the_table():
    for zone, *at in (("America/New_York", 2150, 7, 1, 12), ("America/New_York", 2150, 1, 1, 12), ("America/New_York", 1950, 7, 1, 12), ("Asia/Kolkata", 1943, 1, 1), ("Europe/Berlin", 2100, 8, 9)):
        got, once = TABLE.to_utc(zone, np.array([us(*at), us(2025, 7, 1)]))
        assert got.tolist() == [us(*at, zone=zone), us(2025, 7, 1, zone=zone)] and once.all()
    for skipped_or_twice in ((2150, 3, 8, 2, 30), (2150, 11, 1, 1, 30), (1950, 4, 30, 2, 30)):
        assert not TABLE.to_utc("America/New_York", np.array([us(*skipped_or_twice)]))[1].any()

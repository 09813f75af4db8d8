import random
from datetime import datetime, timedelta

from weftline.operators.spans import covered_and_gaps

BASE = datetime(2024, 1, 1)


def brute(rows):
    out = set()
    by = {}
    for k, s, e, *_ in rows:
        if k is not None and s is not None and e is not None and e >= s:
            by.setdefault(k, set()).add((s, e))
    us = lambda t: int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    for k, iv in by.items():
        cur = None
        for s, e in sorted(iv):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
                continue
            if cur:
                out.add((k, "covered", us(cur[0]), us(cur[1])))
                out.add((k, "gap", us(cur[1]), us(s)))
            cur = [s, e]
        out.add((k, "covered", us(cur[0]), us(cur[1])))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "who string, a timestamp_ntz, b timestamp_ntz, k int, slice int, span_kind string")
    return sorted(tuple(r) for r in covered_and_gaps(df, "who", "a", "b", **kw).collect())


def test_edges(spark):
    us, h = timedelta(microseconds=1), timedelta(hours=1)
    rows = [
        ("touch", BASE, BASE + h), ("touch", BASE + h, BASE + 2 * h),
        ("hole", BASE, BASE + h), ("hole", BASE + h + us, BASE + 2 * h),
        ("nest", BASE, BASE + 90 * h), ("nest", BASE + 2 * h, BASE + 3 * h), ("nest", BASE + 89 * h, BASE + 91 * h), ("nest", BASE + 100 * h, BASE + 101 * h),
        ("point", BASE, BASE), ("point", BASE + us, BASE + us), ("inside", BASE, BASE + h), ("inside", BASE + h, BASE + h),
        ("back", BASE + h, BASE), ("null", None, BASE), ("null", BASE, None), (None, BASE, BASE + h),
        ("twice", BASE, BASE + h), ("twice", BASE, BASE + h),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        s = BASE + timedelta(minutes=rng.randrange(60 * 24 * 20), microseconds=rng.choice([0, 0, 1]))
        rows.append((rng.choice("aaaaabcde"), s, s + timedelta(minutes=rng.choice([0, 0, 1, 5, 30, 600, 4000]) * (rng.random() < 0.5))))
    want = brute(rows)
    for slice_us in (3_600_000_000, 86_400_000_000, 10**15):
        assert run(spark, rows, slice_us=slice_us) == want

from datetime import datetime as D

import pytest

from weftline.functions import bloom
from weftline.operators.orphans import Reference, find_orphans, orphan_report

CHILD = "id string, ref string, created_at timestamp_ntz, ingested_at timestamp_ntz, k string, seen string, reason string, words int"
PARENT = "id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz, p_seen int, maybe boolean"
T = [D(2024, 1, d) for d in range(1, 10)]


def run(spark, kids, parents, **kw):
    c = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in kids], CHILD)
    p = spark.createDataFrame([(*r, 1, True) for r in parents], PARENT)
    out = find_orphans([Reference("t", c, "id", "ref", p, "id")], **kw)
    return sorted((r.record_id, r.ref_month, r.reason) for r in out.collect())


PARENTS = [("U1", T[0], None), ("U1", T[5], None), ("U2", T[0], T[3]), ("U3", T[6], None), (None, T[0], None), ("U4", None, None)]
KIDS = [
    ("a", " u1 ", T[0], T[2]), ("a", " u1 ", T[0], T[4]),  # known, repeated
    ("b", "U2", T[0], T[3]), ("c", "U2", T[0], T[2]),  # deleted at that very time; before
    ("d", "U3", None, T[2]), ("d", "U3", None, T[8]),  # late against the earliest arrival
    ("e", "nobody", T[1], T[1]), ("f", "   ", T[1], T[1]), ("g", None, T[1], T[1]),
    (None, "nobody", T[1], T[1]), ("h", "U4", T[1], None), ("i", "UNKNOWN", T[1], None),
]
WANT = [("b", "2024-01", "deleted"), ("d", "unknown", "late"), ("e", "2024-01", "missing"), ("i", "2024-01", "missing")]


def test_cases_and_clashing_columns(spark):
    assert run(spark, KIDS, PARENTS) == WANT


def test_a_full_filter_changes_nothing(spark):
    kids = [(f"k{i}", f"N{i}", T[0], T[1]) for i in range(300)]
    many = [(f"P{i}", T[0], None) for i in range(3000)]
    got = run(spark, kids, many, max_filter_bits=64)
    assert len(got) == 300 and {r[2] for r in got} == {"missing"}


def test_empty_tables(spark):
    assert run(spark, [], PARENTS) == []
    assert run(spark, [KIDS[0]], []) == [("a", "2024-01", "missing")]


def test_report(spark):
    c = spark.createDataFrame([(*r, "x", "y", "z", 1) for r in KIDS], CHILD)
    p = spark.createDataFrame([(*r, 1, True) for r in PARENTS], PARENT)
    o = find_orphans([Reference("t", c, "id", "ref", p, "id")])
    got = {(r.ref_month, r.reason): r.n_orphans for r in orphan_report(o).collect()}
    assert got == {("2024-01", "deleted"): 1, ("unknown", "late"): 1, ("2024-01", "missing"): 2}


@pytest.mark.parametrize("n", [0, 3, 2000])
def test_bloom_has_no_false_negatives(spark, n):
    keys = spark.range(n).selectExpr("concat('k', id) as k")
    bits = bloom.bits_for(n)
    words = bloom.build(keys, "k", bits)
    probe = spark.range(n + 2000).selectExpr("concat('k', id) as k", "id")
    hit = probe.withColumn("m", bloom.might_contain(words.scalar(), probe.k, bits)).where("m")
    assert hit.where(f"id < {n}").count() == n
    assert hit.where(f"id >= {n}").count() < 100


def test_bloom_with_many_words(spark):
    keys = spark.range(500).selectExpr("concat('k', id) as k")
    words = bloom.build(keys, "k", 1 << 19)
    assert len(words.first().words) == 1 << 13
    hit = keys.withColumn("m", bloom.might_contain(words.scalar(), keys.k, 1 << 19)).where("m").count()
    assert hit == 500

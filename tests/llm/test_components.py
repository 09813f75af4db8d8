import random

from weftline.llm.components import connect, group_matches


def brute(pairs, ids):
    group = {i: i for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        group[y] = x
    return {i: find(i) for i in ids}


def test_random_graphs(spark):
    rng = random.Random(3)
    for n, m in ((40, 25), (200, 230)):
        ids = [f"n{rng.randrange(10**6):06d}" for _ in range(n)]
        pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)]
        df = spark.createDataFrame(pairs + pairs[:5] + [(b, a) for a, b in pairs[:5]] + [(None, "zz"), ("zz", None)], "a string, b string")
        got = {r.id: r.group_id for r in connect(df).collect()}
        used = {i for p in pairs if p[0] != p[1] for i in p}
        assert got == {i: g for i, g in brute(pairs, set(ids)).items() if i in used}


def test_long_chain_and_star(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(300)]
    star = [("hub", f"leaf{i:04d}") for i in range(500)]
    got = {r.id: r.group_id for r in connect(spark.createDataFrame(chain + star, "a string, b string")).collect()}
    assert {got[f"c{i:04d}"] for i in range(301)} == {"c0000"}
    assert {v for k, v in got.items() if not k.startswith("c")} == {"hub"}


def test_members_refused_pairs_and_clashing_columns(spark):
    rows = [("b", "a", "yes", 1), ("c", "b", "no", 2), ("d", "d", "yes", 3), ("e", None, "yes", 4), ("a", "b", "yes", 5), (None, None, "yes", 6)]
    df = spark.createDataFrame(rows, "x string, y string, ok string, id int").withColumnRenamed("ok", "group_id")
    got = {r.id: r.group_id for r in group_matches(df, a="x", b="y", accepted=df.group_id == "yes").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_empty(spark):
    df = spark.createDataFrame([], "a string, b string, ok boolean")
    assert group_matches(df, a="a", b="b", accepted=df.ok).count() == 0

import random

from weftline.llm.leakage import align, chains, drop_leaking, find_leaks, items_leaked, longest_stretch

RNG = random.Random(9)
VOCAB = [f"{a}{b}{c}" for a in ("ba", "ke", "lo", "mi", "tu", "ra") for b in ("ran", "sel", "tim", "vok") for c in ("a", "es", "ing")]
ITEMS = [(i, " ".join(RNG.choice(VOCAB) for _ in range(RNG.randrange(60, 120)))) for i in range(20)]
FILL = [f"filler{i}" for i in range(500)]


def noise(n):
    return " ".join(RNG.choice(FILL) for _ in range(n))


def changed(words, share):
    out = list(words)
    k = int(len(out) * share)
    step = len(out) // (k + 1)
    for j in range(1, k + 1):
        out[j * step] = "altered"
    return out


def docs():
    rows, want = [], set()
    for i, text in ITEMS:
        w = text.split()
        half = w[len(w) // 4 : len(w) // 4 + len(w) // 2 + 1]
        cut = w[: int(len(w) * 0.3)]
        cases = [
            (noise(50) + " " + text + " " + noise(20), True),
            (noise(10) + "\n" + " ".join(half).upper().replace(" ", "  ") + "! " + noise(9), True),
            (" ".join(changed(half, 0.1)), True),
            (" ".join(x + (" [sic]" if k % 13 == 5 else ",") for k, x in enumerate(half)), True),
            (noise(5) + " " + " ".join(cut) + " " + noise(60), False),
            (" ".join(changed(half, 0.34)), False),
            (" ".join(RNG.sample(w, len(w))), False),
            (" ".join(" ".join(w[k : k + 6]) + " " + noise(40) for k in range(0, len(w), 12)), False),
        ]
        for t, hit in cases:
            d = len(rows)
            rows.append((d, t, "a", 0))
            if hit:
                want.add((d, i))
    return rows, want


def run(spark, rows, items=ITEMS, **kw):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, share int")
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id int, text string, doc_id int")
    return find_leaks(d, i, **kw)


def test_planted_passages(spark):
    rows, want = docs()
    got = {(r.doc_id, r.item_id) for r in run(spark, rows).collect()}
    assert got == want


def test_edges(spark):
    rows, _ = docs()
    first = rows[0][1]
    odd = [(1, None, "a", 0), (2, "", "a", 0), (3, "short", "a", 0), (None, first, "a", 0), (4, first, "a", 0), (5, first, "a", 0), (6, noise(200_000) + " " + first, "a", 0), (7, "é​­ " * 50, "a", 0)]
    got = sorted((r.doc_id, r.item_id) for r in run(spark, odd, ITEMS + [(900, None), (901, ""), (902, "two words"), (None, "x y z a b c")]).collect())
    assert got == [(4, 0), (5, 0), (6, 0)]
    assert run(spark, []).count() == 0
    assert run(spark, odd, []).count() == 0


def test_hyphenated_line_ends(spark):
    text = "  \n".join(" ".join(ITEMS[0][1].split()[k : k + 7]) for k in range(0, 60, 7)).replace("ran", "ra-\nn", 3)
    assert run(spark, [(1, text, "a", 0)]).count() == 1


def test_reports(spark):
    rows, want = docs()
    leaks = run(spark, rows)
    per = {r.item_id: r.n_documents for r in items_leaked(leaks).collect()}
    assert per == {i: 4 for i, _ in ITEMS}
    d = spark.createDataFrame(rows, "doc_id bigint, text string, item_id string, share int")
    assert drop_leaking(d, leaks).count() == len(rows) - len({x for x, _ in want})


def test_parts():
    assert align(list("abxde"), list("abcde"), 3) == [0, 1, -1, 3, 4]
    assert align("a b mark c d".split(), "a b c d".split(), 3) == [0, 1, 3, 4]
    assert longest_stretch([0, 1, 2, -1, -1, -1, 6, 7, 8, 9], 0.1, 4) == (6, 9)
    assert longest_stretch([-1, -1], 0.1, 4) == (0, -1)
    import numpy as np

    c = chains(np.array([0, 1, 2, 90, 91]), np.array([5, 6, 7, 8, 9]))
    assert sorted(len(x) for x in c) == [2, 3]


def test_longest_stretch_against_all_pairs():
    rng = random.Random(9)
    for _ in range(200):
        match, at = [], 0
        for _ in range(rng.randint(1, 40)):
            at += 1 if rng.random() < 0.85 else rng.randint(2, 9)
            match.append(at if rng.random() < 0.85 else -1)
        seen = [i for i, m in enumerate(match) if m >= 0]
        best = 0
        for x, i in enumerate(seen):
            for y in range(x, len(seen)):
                j = seen[y]
                cost = sum(m < 0 for m in match[i : j + 1]) + sum(max(0, match[q] - match[p] - (q - p) - 4) for p, q in zip(seen[x:y], seen[x + 1 : y + 1]))
                if cost <= 0.1 * (j - i + 1) + 1e-9:
                    best = max(best, j - i + 1)
        first, last = longest_stretch(match, 0.1, 4)
        assert last - first + 1 == best
    big = list(range(30_000))
    assert longest_stretch(big, 0.1, 4) == (0, 29_999)


def test_changes_packed_at_one_end(spark):
    """A stretch of 40 words of which the first 20 hold all four changes, so that no five of them go along."""
    rng = random.Random(1)
    item = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(100)]
    copied = list(item[30:70])
    for i in (4, 9, 14, 19):
        copied[i] = "changed"
    docs = spark.createDataFrame([(1, " ".join(["other"] * 30 + copied + ["more"] * 30)), (2, " ".join(["other"] * 30 + copied[3:] + ["more"] * 30))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id int, text string")
    assert [(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()] == [(1, 7)]

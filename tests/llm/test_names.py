import random

import pytest

from weftline.llm.names import link_names, linked_pairs, one_edit, similar_tokens, sound

SCHEMA = "entity_id string, name string, type string, kind string, group_id string, token string"
ALIASES = [("Robert", "Bob"), ("Robert", "Rob"), ("Edward", "Ted"), ("Theodore", "Ted"), ("Nicholas", "Nick"), (None, "X")]


def pairs(spark, rows, aliases=ALIASES):
    e = spark.createDataFrame([(*r, "k", "g", "t") for r in rows], SCHEMA)
    a = spark.createDataFrame(aliases, "given_name string, short_name string")
    return {(r.entity_id_a, r.entity_id_b) for r in linked_pairs(link_names(e, a)).collect()}


PERSONS = [
    ("p01", "Robert Hokabachas", "PERSON"), ("p02", "HOKABACHAS, ROBERT", "person"), ("p03", "Bob Hokabachsa", "PER"), ("p04", "Hokabachas R.", "Person"),
    ("p05", "Rob Hokabachas @ Bobby", "PERSON"), ("p06", "Mr. Robert K. Hokabachas", "PERSON"),
    ("p11", "Nicholas Hokabachas", "PERSON"), ("p12", "Nick  Hokabachas", "PERSON"), ("p13", "nicholas hokaabachas", "PERSON"),
    ("p21", "Robert Zuvimandor", "PERSON"), ("p22", "Robert Zuvimandoor", "PERSON"),
    ("p31", "Edward Kalimutossen", "PERSON"), ("p32", "Ted Kalimutossen", "PERSON"), ("p33", "Kalimutossen, E", "PERSON"),
    ("p41", "Edward Brihopocher", "PERSON"), ("p42", "Theodore Brihopocher", "PERSON"), ("p43", "Ted Brihopocher", "PERSON"),
    ("p51", "Robert Selomatukar", "DEVICE"), ("p52", None, "PERSON"), ("p53", "  ", "PERSON"), (None, "Robert Hokabachas", "PERSON"), ("p54", "Robert Hokabachas", None),
    ("p61", "Robert", "PERSON"), ("p62", "x " * 3000, "PERSON"), ("p63", "...", "PERSON"),
] + [(f"f{i}", f"{g} {'Solo Mekar Tivan Buroz Wafel Gudin Pyxor Hanse Jolat Cirem'.split()[i]}{'utes arab ino elk udon'.split()[i % 5]}", "PERSON") for i, g in enumerate(["Robert", "Edward", "Nicholas", "Theodore", "Robert", "Edward", "Nicholas", "Theodore", "Robert", "Nicholas"])]
ORGS = [
    ("o01", "Bisudosukar Travel Agency & Sons", "ORG"), ("o02", "M/s Bisudosukar Tarvel Agency, & Sons", "Organisation"), ("o03", "BISUDOSUKAR TRAVEL AGCY LTD", "ORGANIZATION"), ("o04", "Travel Agency Bisudosukar", "ORG"),
    ("o11", "Bisudosukar Cold Storage Ltd", "ORG"), ("o12", "The Bisuodsukar Cold Stor. Pvt Ltd", "ORG"),
    ("o21", "Vekhejozem Cold Storage L.L.P.", "ORG"), ("o22", "Vekhejozem Travel Agency", "ORG"), ("o23", "Karidrofon Cold Storage", "ORG"), ("o24", "Pubogunur Travel Agency", "ORG"), ("o25", "Ltd", "ORG"),
]


def block(*ids):
    return {(a, b) for a in ids for b in ids if a < b}


def test_persons_and_organisations(spark):
    got = pairs(spark, PERSONS + ORGS + PERSONS[:3])
    want = block("p01", "p02", "p03", "p04", "p05", "p06") | block("p11", "p12", "p13") | block("p21", "p22") | block("p31", "p32", "p33")
    want |= block("o01", "o02", "o03", "o04") | block("o11", "o12")
    assert got == want


def test_empty(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, PERSONS[:2], []) == block("p01", "p02")


def test_an_id_with_two_spellings_joins_both_groups(spark):
    got = pairs(spark, PERSONS[:2] + [("p02", "Edward Kalimutossen", "PERSON")] + PERSONS[11:12])
    assert got == {("p01", "p02"), ("p02", "p31")}


def edit_one(a, b):
    """Brute force: one insertion, deletion, replacement or swap."""
    if a == b:
        return True
    alphabet = set(b)
    near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in alphabet}
    near |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in alphabet} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    return b in near


def test_similar_tokens_against_brute_force(spark):
    rng = random.Random(2)
    words = set()
    for _ in range(60):
        w = "".join(rng.choice("abdeikorst") for _ in range(rng.randrange(4, 9)))
        words.add(w)
        for _ in range(3):
            i = rng.randrange(len(w) - 1)
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abk") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "z" + w[i + 1 :]]))
    words = sorted(w for w in words if len(w) >= 4)
    df = spark.createDataFrame([("person", w, w) for w in words], "kind string, token string, key string")
    got = {(r.a, r.b) for r in similar_tokens(df).collect()}
    want = {(a, b) for a in words for b in words if a < b and edit_one(a, b)}
    assert got == want


@pytest.mark.parametrize(("a", "b", "same"), [("abcd", "abdc", True), ("abcd", "abcde", True), ("abcd", "acbd", True), ("abcd", "badc", False), ("abcd", "abef", False), ("ab", "ab", True)])
def test_one_edit(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert bool(df.select(one_edit("a", "b").alias("x")).first().x) is same


def test_sounds(spark):
    df = spark.createDataFrame([("zuvemandoor", "zuvemandur"), ("gapozeeshessen", "gapozishesen"), ("payasuyatow", "payasuyatov")], "a string, b string")
    assert all(r.x == r.y for r in df.select(sound(df.a).alias("x"), sound(df.b).alias("y")).collect())


def test_similar_short_tokens_against_all_pairs(spark):
    """No pair one edit apart is missed, whatever the length."""
    rng = random.Random(17)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(160)} | {"abcde", "abced", "aaaa", "aaaaa"})
    v = spark.createDataFrame([("person", w, w) for w in words], "kind string, token string, key string")
    got = {(r.a, r.b) for r in similar_tokens(v).collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_similarity_decides_among_representatives(spark):
    """A misspelt given name goes to the near one that this family has, though another is commoner elsewhere; weights and bars count."""
    rows = [(f"k{i}", "person", f"marta {f}") for i, f in enumerate(["zolenberg", "quistrop", "vandermol", "hexworthy", "illingsworth", "jarvenpaa"] * 4)]
    rows += [(f"m{i}", "person", "maria tibbelwick") for i in range(3)] + [("x", "person", "marja tibbelwick"), ("y", "person", "maria tibbelwick")]
    e = spark.createDataFrame(rows, "entity_id string, type string, name string")
    a = spark.createDataFrame([], "given_name string, short_name string")
    g = {r.entity_id: r.group_id for r in link_names(e, a).collect()}
    assert g["x"] == g["y"] == g["m0"] and g["k0"] != g["k1"]
    strict = {r.entity_id for r in link_names(e, a, min_score=0.99).collect()}
    assert "x" not in strict and "y" in strict

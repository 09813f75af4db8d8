import random

import numpy as np
import pytest

from weftline.llm import toxicity as T

RNG = random.Random(4)
NAMES = ["anil", "bora", "celso", "dita", "emre", "farid"]
FILL = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su", "ve") for b in ("ran", "del", "kin", "pos", "mat", "lor", "bit", "gen", "fus", "har")]
CLEAN = ["the clerk stamped page {n} near the gate", "{p} left a parcel at the depot", "the bitch and her pups moved to kennel {n}", "burnt rubber was noted near dock {n}", "a sexual harassment policy was read to {p}", "no toll record for plate {n}", "{p} from a velmari family helped to translate"]
BAD = {
    "abuse": ["what a worthless idiot you are {p}", "shut your filthy mouth you bastard", "go to hell you lying scumbag"],
    "hate": ["all velmari are vermin and should be driven out", "never trust a velmari they are born thieves"],
    "sexual": ["send me nude pictures tonight and i will pay", "i want you naked in my bed"],
}


def say(t):
    return t.format(p=RNG.choice(NAMES), n=RNG.randrange(1000))


def plain():
    """A sentence of words that occur in many documents of either kind."""
    return " ".join(RNG.choice(FILL) for _ in range(RNG.randrange(4, 12)))


def doc(kind):
    parts = [say(RNG.choice(CLEAN)) if RNG.random() < 0.4 else plain() for _ in range(RNG.randrange(4, 14))]
    if kind != "none":
        parts.insert(RNG.randrange(len(parts) + 1), say(RNG.choice(BAD[kind])))
    return ". ".join(parts)


def sample(n, wrong=0.05):
    rows = []
    for i in range(n):
        real = RNG.choice(["none"] * 7 + list(BAD))
        given = real if RNG.random() > wrong else RNG.choice(["none", *BAD])
        rows.append((i, doc(real), real, given))
    return rows


def test_held_out_accuracy():
    train, test = sample(900), sample(400)
    chain = T.train([r[1] for r in train], [r[3] for r in train])
    s = chain.score([r[1] for r in test])
    said, real = s[:, 3] >= 0.4, np.array([r[2] != "none" for r in test])
    assert (said & real).sum() >= 0.95 * real.sum()
    assert (said & ~real).sum() <= 0.03 * (~real).sum()
    kinds = np.array([T.CATEGORIES[k] for k in s[:, :3].argmax(axis=1)])
    assert (kinds[real & said] == np.array([r[2] for r in test])[real & said]).mean() > 0.9


def test_disguises():
    train = sample(900, 0.0)
    chain = T.train([r[1] for r in train], [r[3] for r in train])
    bad = ["SHUT YOUR FILTHY MOUTH YOU B A S T A R D", "shut your f1lthy m0uth you bast@rd", "go to hell you lying s*****g", "all velmari are v-e-r-m-i-n and should be driven out", "i want you naaaaked in my bed", "send me nude pict​ures tonight and i will pay"]
    good = ["The Bitch and her pups moved to kennel 7", "plate 1337 5318 seen", ""]
    s = chain.score(bad + good)[:, 3]
    assert (s[: len(bad)] >= 0.4).all() and (s[len(bad) :] < 0.4).all()


def test_words():
    assert T.tokens_of("Go, s h i t! r.a.t.s") == ["go", "shit", "!", "rats"]
    assert [T.plain(x) for x in ("5w1n3", "n@k3d", "raaaats", "2024", "ok")] == ["swine", "naked", "rats", "0", "ok"]


def test_operator_and_rates(spark):
    rows = sample(500, 0.0)
    docs = [(r[0], r[1], "s1" if r[0] % 3 else "s2", 0.5) for r in rows] + [(9001, None, "s1", 0.1), (9002, "", None, 0.1), (9003, "the clerk stamped page " * 20_000, "s1", 0.1), (9004, rows[0][1], "s1", 0.1), (None, "x", "s1", 0.1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, any_ double").withColumnRenamed("any_", "label")
    labels = [(r[0], r[3], "rev", 1) for r in rows] + [(r[0], r[3], "rev", 2) for r in rows[:50]] + [(77777, "abuse", "rev", 1), (9004, None, "rev", 1), (9003, "odd", "rev", 1)]
    lab = spark.createDataFrame(labels, "doc_id bigint, label string, reviewer string, text int")
    s = T.score_documents(d, lab, keep=("source",))
    got = {r.doc_id: r.any for r in s.collect()}
    assert len(got) == len(docs)
    right = sum((got[r[0]] >= 0.4) == (r[2] != "none") for r in rows)
    assert right >= 0.97 * len(rows)
    assert got[9001] == got[9002] == 0 or max(got[9001], got[9002]) < 0.1
    per = {r.source: r for r in T.rates(s, "source", 0.4).collect()}
    assert sum(r.n_documents for r in per.values()) == len(docs)
    assert all(0 <= r.rate <= 1 for r in per.values())


def test_without_labels_or_documents(spark):
    d = spark.createDataFrame([(1, "go to hell")], "doc_id bigint, text string")
    lab = spark.createDataFrame([], "doc_id bigint, label string")
    assert [r.any for r in T.score_documents(d, lab).collect()] == [0.0]
    assert T.score_documents(d.limit(0), lab).count() == 0
    one = spark.createDataFrame([(1, "abuse")], "doc_id bigint, label string")
    assert [r.any for r in T.score_documents(d, one).collect()] == [0.0]


def test_copies_behind_a_common_ngram():
    rng, common, n = np.random.default_rng(3), np.uint64(12345), 400
    own = rng.integers(1, 2**63, n - 1).astype(np.uint64)
    own = np.append(own, own[-1])  # the last is a copy of the one before it
    doc = np.concatenate([np.arange(n), np.arange(n)])
    keep = T._not_copies(doc, np.concatenate([own, np.full(n, common)]), n)
    assert keep[n - 2] and not keep[n - 1]


@pytest.mark.parametrize("seed", range(8))
def test_held_out_over_several_seeds(seed):
    """Filler that occurs in either kind of document, hard negatives, copies and 5 to 10 % wrong labels."""
    RNG.seed(1200 + seed)
    train, test = sample(900, 0.05 + 0.05 * (seed % 2)), sample(800)
    chain = T.train([r[1] for r in train], [r[3] for r in train])
    said, real = chain.score([r[1] for r in test])[:, -1] >= chain.threshold, np.array([r[2] != "none" for r in test])
    assert (said & real).sum() >= 0.95 * real.sum()
    assert (said & real).sum() >= 0.95 * said.sum()


def test_a_phrase_of_few_flagged_documents_is_no_evidence():
    RNG.seed(77)
    rows = sample(900, 0.05)
    flagged = [i for i, r in enumerate(rows) if r[3] != "none"][:5]
    clean = [i for i, r in enumerate(rows) if r[3] == "none"][:24]
    texts = [r[1] + ". he was told to trust nobody" if i in flagged or i in clean else r[1] for i, r in enumerate(rows)]
    chain = T.train(texts, [r[3] for r in rows])
    assert chain.score(["he was told to trust nobody"])[0, -1] < chain.threshold


def test_disguise_of_long_words():
    assert T.plain("b@ckst4bbingscum") == "backstabbingscum"

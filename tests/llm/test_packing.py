import os
import random

import numpy as np
import pytest

from weftline.llm import packing as P

pytestmark = pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer here")


@pytest.mark.parametrize("capacity", [7, 64, 512])
def test_plan_holds_everything(capacity):
    rng = np.random.default_rng(capacity)
    for scale in (1, 50, 100_000):
        h = np.zeros(capacity + 1, dtype=np.int64)
        for ln in rng.integers(1, capacity + 1, 40):
            h[ln] += int(rng.integers(1, 4)) * scale
        groups = P.plan(h, capacity)
        back = np.zeros_like(h)
        for times, parts in groups:
            assert times > 0 and sum(ln * c for ln, c in parts.items()) <= capacity
            for ln, c in parts.items():
                back[ln] += times * c
        assert (back == h).all()
        assert len(groups) < 20 * capacity + 2000  # bounded by the capacity, not by the items
        slots = P.Slots(groups)
        used = np.zeros(slots.containers, dtype=np.int64)
        if scale < 1000:
            for ln in np.flatnonzero(h):
                np.add.at(used, slots.of(int(ln), np.arange(h[ln])), ln)
            assert used.max() <= capacity and used.min() > 0


def test_plentiful_lengths_share_containers():
    for n in (1_000, 1_000_000):
        h = np.zeros(513, dtype=np.int64)
        h[[300, 100]] = n
        groups = P.plan(h, 512)
        assert sum(t * p.get(300, 0) for t, p in groups) == sum(t * p.get(100, 0) for t, p in groups) == n
        assert sum(t for t, _ in groups) <= 1.001 * n


def test_empty_and_full_histograms():
    assert P.plan(np.zeros(9, dtype=np.int64), 8) == []
    h = np.zeros(9, dtype=np.int64)
    h[8] = 5
    assert P.plan(h, 8) == [(5, {8: 1})]


def test_fit_is_close():
    h = np.zeros(11)
    h[[3, 7, 5]] = 30, 30, 20
    pats = P.patterns(np.array([3, 5, 7]), 10)
    x = P.fit(pats, h)
    back = np.zeros(11)
    for k, p in enumerate(pats):
        for ln, c in p:
            back[ln] += x[k] * c
    assert np.abs(back - h).max() < 0.5 and (x >= 0).all()


def test_pack_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "river", "मामला", "42"]) for _ in range(rng.choice([1, 3, 10, 30, 90]))) for _ in range(300)]
    texts += ["", "", None, "same text", "same text", "word " * 5000]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, size_id int, n_tokens int, bucket string")
    sizes = spark.createDataFrame([(1, 64, 0), (2, 500, 0), (2, 500, 0), (3, None, 0)], "size_id int, capacity_tokens int, doc_id int")
    items = P.pack(docs, sizes).toPandas()
    enc = P.encoding(P.TOKENIZER)
    for size, cap in ((1, 64), (2, 500)):
        part = items[items.size_id == size]
        assert part.groupby("container_id").n_tokens.sum().max() <= cap
        for i, t in enumerate(texts):
            mine = part[part.doc_id == i].sort_values("part")
            if t is None:
                assert mine.empty
                continue
            n = len(enc.encode_ordinary(t))
            assert mine.n_tokens.sum() == n
            assert len(mine) == max(1, -(-n // cap))  # whole unless above the capacity
            assert mine.start_token.tolist() == [k * cap for k in range(len(mine))]
        ids = sorted(part.container_id.unique())
        assert ids == list(range(len(ids)))
        assert part.n_tokens.sum() / (len(ids) * cap) > 0.9
    boxes = P.containers(P.pack(docs, sizes))
    assert boxes.selectExpr("sum(n_items) n").first().n == len(items)


def test_no_documents_or_sizes(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    sizes = spark.createDataFrame([(1, 64)], "size_id int, capacity_tokens int")
    assert P.pack(docs, sizes).count() == 0
    assert P.pack(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), sizes.limit(0)).count() == 0
    assert P.pack(spark.createDataFrame([(1, ""), (2, "")], "doc_id bigint, text string"), sizes).count() == 2


@pytest.mark.parametrize("capacity", [512, 2048])
@pytest.mark.parametrize("items", [10_000, 10**9])
def test_plan_of_log_normal_lengths(capacity, items):
    """Within 0.1 % of the least, and groups bounded by the capacity, up to 10^9 texts."""
    drawn = np.random.default_rng(items % 97).lognormal(5.5, 1.2, min(items, 1_000_000)).astype(int) + 1
    h = np.bincount(drawn % capacity, minlength=capacity + 1).astype(np.int64) * max(1, items // len(drawn))
    h[capacity] += int((drawn // capacity).sum()) * max(1, items // len(drawn))
    h[0] = 0
    groups = P.plan(h, capacity)
    back = np.zeros_like(h)
    for times, parts in groups:
        for ln, c in parts.items():
            back[ln] += times * c
    assert (back == h).all()
    least = -(-int((h * np.arange(capacity + 1)).sum()) // capacity)
    assert sum(t for t, _ in groups) <= 1.001 * least + 1
    assert len(groups) <= 20 * capacity


def test_best_fit_by_counts_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for _ in range(30):
        capacity = int(rng.integers(5, 60))
        h = np.zeros(capacity + 1, dtype=np.int64)
        h[1:] = rng.integers(0, 4, capacity)
        free: list[int] = []
        for ln in np.flatnonzero(h)[::-1]:
            for _ in range(h[ln]):
                fits = [k for k, room in enumerate(free) if room >= ln]
                k = min(fits, key=lambda k: free[k]) if fits else len(free)
                if not fits:
                    free.append(capacity)
                free[k] -= ln
        groups = P.best_fit(h, capacity)
        assert sum(t for t, _ in groups) == len(free)
        assert sorted(free) == sorted(capacity - sum(ln * c for ln, c in m.items()) for t, m in groups for _ in range(t))
        assert len(groups) <= 3 * capacity


def test_capacities_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "AT_ONCE", 2)
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(20)], "doc_id bigint, text string")
    sizes = spark.createDataFrame([(k, 30 + k) for k in range(5)], "size_id int, capacity_tokens int")
    items = P.pack(docs, sizes)
    assert items.groupBy("size_id").count().count() == 5 and items.select("size_id", "doc_id", "part").distinct().count() == items.count()

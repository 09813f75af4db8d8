"""Passages of held-out test items inside a training corpus.

The test items' normalised word n-grams form one hash set, broadcast to all tasks (its size is
that of the test suites and is checked). Each document's word windows are hashed with numpy and
looked up in the set; only pairs of a document and an item with enough collinear hits are
aligned word by word, and the longest stretch of the item that the document repeats with at most
``max_changed`` changed words decides. One scan, no shuffle; every document, its whole text.

Words are maximal runs of letters, digits and marks that belong to letters, in lower case; a
hyphenated line end is joined, so case, punctuation, spacing and line breaks do not count. Up to
``insert_free`` words inserted at one place (marks, line numbers) are passed over.

Defined results: null or empty texts and items shorter than n words give nothing; repeated
documents are reported by their own ids; repeated items by theirs. A document with several
passages of one item gives one row, for the longest.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=\w)[-‐­][ \t]*\r?\n\s*(?=\w)")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
MAX_SET_WORDS = 20_000_000  # of all items together: the bound of what is broadcast


def clean(text: str) -> str:
    """Lower case without invisible characters and hyphenated line ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    if "-\n" in text or "-\r" in text or "- \n" in text or "‐\n" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


def _mix(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n ids; 0 where a window holds an unknown word (id 0)."""
    w = len(ids) - n + 1
    if w <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, known = np.zeros(w, dtype=np.uint64), np.ones(w, dtype=bool)
    for k in range(n):
        part = ids[k : k + w]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (part.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        h ^= h >> np.uint64(29)
        known &= part > 0
    return np.where(known, h | np.uint64(1), np.uint64(0))


class NgramSet:
    """Hash set of the items' word n-grams with the places where each occurs."""

    def __init__(self, items: list[tuple[int, str]], n: int, min_share: float, max_changed: float, insert_free: int):
        self.n, self.min_share, self.max_changed, self.insert_free = n, min_share, max_changed, insert_free
        words = [(i, WORD.findall(clean(t))) for i, t in items if isinstance(t, str)]
        words = [(i, w) for i, w in words if len(w) >= n]
        if sum(len(w) for _, w in words) > MAX_SET_WORDS:
            raise ValueError("the test items are too large to broadcast; pass them in parts")
        self.ids = [i for i, _ in words]
        self.words = [w for _, w in words]
        self.vocab: dict[str, int] = {}
        for _, ws in words:
            for w in ws:
                self.vocab.setdefault(w, len(self.vocab) + 1)
        hashes, item, place = [], [], []
        for k, ws in enumerate(self.words):
            h = _mix(np.array([self.vocab[w] for w in ws], dtype=np.int64), n)
            hashes.append(h)
            item.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = np.concatenate(item)[order] if hashes else np.zeros(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.zeros(0, dtype=np.int64)
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)

    def least_words(self, k: int) -> int:
        return max(self.n, int(np.ceil(self.min_share * len(self.words[k]))))

    def candidates(self, hashes: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(document, item, window places, item places) of the pairs with enough hits."""
        if not len(self.keys) or not len(hashes):
            return
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        pos = np.flatnonzero((self.keys[at] == hashes) & (hashes != 0))
        if not len(pos):
            return
        rows = at[pos]
        n = self.count[rows]
        start = np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        entry = start + np.arange(n.sum())
        where, item, place = np.repeat(pos, n), self.item[entry], self.place[entry]
        pair = doc_of[where] * np.int64(len(self.ids)) + item
        order = np.argsort(pair, kind="stable")
        pair, where, place = pair[order], where[order], place[order]
        cuts = np.flatnonzero(np.diff(pair)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(pair)]])):
            k = int(pair[lo] % len(self.ids))
            # a passage of m words with c changed ones keeps m - (n - 1) - n * c windows; marks inserted
            # between words cost as many again, hence the lower bar
            m = self.least_words(k)
            if hi - lo >= max(2, (m * (1 - 2 * self.n * self.max_changed) - self.n + 1), 0.2 * m):
                yield int(pair[lo] // len(self.ids)), k, where[lo:hi], place[lo:hi]


def chains(where: np.ndarray, place: np.ndarray, drift: int = 12, hole: int = 25) -> list[list[tuple[int, int]]]:
    """Runs of hits (document window, item place) that advance together."""
    order = np.lexsort((place, where))
    open_: list[list[tuple[int, int]]] = []
    done: list[list[tuple[int, int]]] = []
    for w, p in zip(where[order].tolist(), place[order].tolist()):
        best = None
        for c in open_:
            lw, lp = c[-1]
            if w > lw and 0 < p - lp <= hole and abs((w - p) - (lw - lp)) <= drift and (best is None or len(c) > len(best)):
                best = c
        if best is not None:
            best.append((w, p))
        else:
            done += [c for c in open_ if w - c[-1][0] > hole + drift]
            open_ = [c for c in open_ if w - c[-1][0] <= hole + drift]
            open_.append([(w, p)])
    return done + open_


def _alike(a: str, b: str) -> bool:
    """Equal, or one scanning fault apart."""
    if a == b:
        return True
    if len(a) != len(b) or len(a) < 4:
        return False
    return sum(x != y for x, y in zip(a, b)) == 1


def align(doc: list[str], item: list[str], band: int) -> list[int]:
    """For each item word, the document word it matches, or -1: most matches, then fewest insertions.

    Both start together; ``band`` is how far the alignment may wander from the diagonal.
    """
    nd, ni = len(doc), len(item)
    far = -(10**9)
    prev_lo, prev = 0, [-0.3 * j for j in range(min(nd, band) + 1)]
    back: list[tuple[int, list[int]]] = []
    for i in range(1, ni + 1):
        lo, hi = max(0, min(i, nd) - band), min(nd, i + band)
        row, step = [], []
        w = item[i - 1]
        left = far
        for j in range(lo, hi + 1):
            k = j - prev_lo
            up = prev[k] - 1.0 if 0 <= k < len(prev) else far
            diag = far
            hit = False
            if j > 0 and 0 <= k - 1 < len(prev):
                hit = _alike(doc[j - 1], w)
                diag = prev[k - 1] + (2.0 if hit else -0.9)
            ins = left - 0.3
            if diag >= up and diag >= ins:
                row.append(diag)
                step.append(2 if hit else 1)
            elif up >= ins:
                row.append(up)
                step.append(3)
            else:
                row.append(ins)
                step.append(4)
            left = row[-1]
        back.append((lo, step))
        prev_lo, prev = lo, row
    out = [-1] * ni
    j = prev_lo + int(np.argmax(prev))
    i = ni
    while i > 0:
        lo, step = back[i - 1]
        if not lo <= j < lo + len(step):
            break
        s = step[j - lo]
        if s == 4:
            j -= 1
        elif s == 3:
            i -= 1
        else:
            if s == 2:
                out[i - 1] = j - 1
            i, j = i - 1, j - 1
        if j < 0:
            break
    return out


def follow(chain: list[tuple[int, int]], n: int, doc: list[str], item: list[str], least: int, stretch, reach: int, slack: int) -> list[int]:
    """For each item word the document word it matches, or -1, along a chain of hits.

    Words inside hits are equal by construction; only the holes between hits are aligned, and the
    ends only where the stretch so far could still reach ``least`` words.
    """
    match = [-1] * len(item)
    for w, p in chain:
        match[p : p + n] = range(w, w + n)
    seen = [p for p in range(chain[0][1], chain[-1][1] + n) if match[p] >= 0]
    for p, q in zip(seen, seen[1:]):
        if q - p > 1:
            a, b = match[p] + 1, match[q]
            if b - a == q - p - 1:
                for k in range(b - a):
                    if _alike(doc[a + k], item[p + 1 + k]):
                        match[p + 1 + k] = a + k
            elif b > a:
                part = align(doc[a:b], item[p + 1 : q], b - a + 1)
                match[p + 1 : q] = [a + m if m >= 0 else -1 for m in part]
    first, last = stretch(match)
    if last - first + 1 + slack < least:
        return match
    p, w = chain[-1][1] + n, chain[-1][0] + n
    while p < len(item) and w < len(doc):  # on as long as half of the next words go along
        part = align(doc[w : w + reach + 8], item[p : p + reach], 8)
        match[p : p + len(part)] = [w + m if m >= 0 else -1 for m in part]
        hit = [k for k, m in enumerate(part) if m >= 0]
        if 2 * len(hit) < reach:
            break
        p, w = p + hit[-1] + 1, w + part[hit[-1]] + 1
    w, p = chain[0]
    while p > 0 and w > 0:
        d0, i0 = max(0, w - reach - 8), max(0, p - reach)
        part = align(doc[d0:w][::-1], item[i0:p][::-1], 8)
        match[i0:p] = [w - 1 - m if m >= 0 else -1 for m in part][::-1]
        hit = [k for k, m in enumerate(part) if m >= 0]
        if 2 * len(hit) < reach:
            break
        p, w = p - hit[-1] - 1, w - part[hit[-1]] - 1
    return match


def longest_stretch(match: list[int], max_changed: float, insert_free: int) -> tuple[int, int]:
    """Longest [first, last] of item words, ends matched, with at most the share of changed words."""
    n = len(match)
    m = np.array(match)
    cost = (m < 0).astype(float)
    seen = np.flatnonzero(m >= 0)
    if not len(seen):
        return 0, -1
    jump = np.diff(m[seen]) - np.diff(seen)  # document words inserted before a matched word
    cost[seen[1:]] += np.maximum(0, jump - insert_free)
    total = np.concatenate([[0.0], np.cumsum(cost)])
    # [first, last] is good where a[last] <= b[first]; of the firsts, the running maximum of b meets each last soonest
    a = total[seen + 1] - max_changed * (seen + 1)
    b = np.maximum.accumulate(total[seen] + cost[seen] - max_changed * seen)
    first = np.searchsorted(b, a - 1e-9)
    good = np.flatnonzero(first <= np.arange(len(seen)))
    if not len(good):
        return 0, -1
    best = good[np.argmax(seen[good] - seen[first[good]])]
    return int(seen[first[best]]), int(seen[best])


def _scan(ids: np.ndarray, texts: list[str], grams: NgramSet) -> list[tuple]:
    found: list[tuple] = []
    cleaned = [clean(t) for t in texts]
    words = [WORD.findall(t) for t in cleaned]
    flat = np.fromiter((x for ws in words for x in map(grams.vocab.get, ws, repeat(0))), dtype=np.int64)
    sizes = np.array([len(w) for w in words])
    doc_of = np.repeat(np.arange(len(words)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    h = _mix(flat, grams.n)
    doc_w = doc_of[: len(h)]
    h[doc_w != doc_of[grams.n - 1 : grams.n - 1 + len(h)]] = 0  # windows across two documents
    for d, k, where, place in grams.candidates(h, doc_w):
        item, doc, least = grams.words[k], words[d], grams.least_words(k)
        best = None
        # ends are followed in steps of two windows; the changes allowed can keep hits from so many words of a passage
        reach, slack = 2 * grams.n + 2, int(least * grams.n * grams.max_changed) + 2 * grams.n
        stretch = lambda m: longest_stretch(m, grams.max_changed, grams.insert_free)
        for chain in chains(where - begin[d], place):
            if chain[-1][1] + grams.n - chain[0][1] + slack < least:
                continue
            match = follow(chain, grams.n, doc, item, least, stretch, reach, slack)
            a, b = stretch(match)
            if b - a + 1 >= least and (best is None or b - a + 1 > best[0]):
                best = (b - a + 1, match[a], match[b])
        if best:
            found.append((ids[d], grams.ids[k], best[0], best[0] / len(item), best[1], best[2]))
    return found


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 5,
    min_share: float = 0.4,
    max_changed: float = 0.1,
    insert_free: int = 4,
    block: int = 500,
) -> DataFrame:
    """(doc_id, item_id, n_words, share, first_word, last_word) of each leak, words counted in the document."""
    pairs = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = pairs.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > 10 * MAX_SET_WORDS:
        raise ValueError("the test items are too large to broadcast; pass them in parts")
    rows = sorted((r.i, r.t) for r in pairs.distinct().collect())
    grams = documents.sparkSession.sparkContext.broadcast(NgramSet(rows, n, min_share, max_changed, insert_free))
    names = ["doc_id", "item_id", "n_words", "share", "first_word", "last_word"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), block):
                part = b.iloc[lo : lo + block]
                yield pd.DataFrame(_scan(part["d"].to_numpy(), part["t"].tolist(), grams.value), columns=names)

    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    return (
        documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
        .where("d is not null and t is not null and t <> ''")
        .mapInPandas(scan, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int, share double, first_word int, last_word int")
    )


def drop_leaking(documents: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without any leak."""
    return documents.join(leaks.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")


def items_leaked(leaks: DataFrame) -> DataFrame:
    """(item_id, n_documents, n_whole) of each leaked item; whole: at least nine tenths of it."""
    return leaks.groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("n_documents"),
        F.count_if(F.col("share") >= 0.9).alias("n_whole"),
    )

"""Abusive, hateful or sexual passages, scored by chains of linear classifiers.

Training: reviewed documents (a bounded, documented sample) are cut into short windows of words.
A document's label says that some window is of that kind, so windows are chosen first by n-grams
that go with flagged documents beyond chance, then by the model itself. The categories, and last
whether any of them holds, form a chain: the linear model of each also sees the probabilities of the
earlier ones, which in training are out-of-fold predictions, so that it meets them as they are on
unseen text. Probabilities are calibrated to the windows' real share, and the threshold is chosen on
documents that the n-grams, windows and weights of their fold's model were not chosen on.

Scoring: one scan of all documents with the sorted feature keys and weights broadcast (bounded by
the training sample); every window of every document is scored with numpy, and a document's score is
that of its worst window. No shuffle.

Words are compared after undoing disguises: letter case, look-alike digits and signs, letters set
apart, stretched letters, and masked letters where a known flagged word fits.

Defined results: null or empty texts score 0; documents are scored whole, whatever their length;
labels of unknown documents or of other kinds are ignored, and of several labels the commonest
counts (the most serious in a tie); without both flagged and clean labels every score is 0.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("abuse", "hate", "sexual")
BLOCK = 10  # a window is two neighbouring blocks of words of one sentence
_WC = r"[\wऀ-ॿ]"
_TOKEN = re.compile(rf"[@$*#]*{_WC}+(?:[@$*#!]+{_WC}+)*[*#$]*|[.!?।\n]")
_APART = re.compile(r"(?<![\wऀ-ॿ])(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?![\wऀ-ॿ])")
_APART_SEP = re.compile(r"[ .\-_*]")
_STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
_INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: Digits and signs that stand for letters, and look-alike letters of other scripts (fixed values).
_LOOKS = str.maketrans("013457890@$!|", "oieasтbgoasil".replace("т", "t"))
_SCRIPTS = str.maketrans("аеорсухіјѕԁһ", "aeopcyxijsdh")
_MASK = re.compile(r"[*#_]")


def tokens_of(text: str) -> list[str]:
    """Words and sentence ends, in lower case, with letters set apart joined."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    text = _APART.sub(lambda m: _APART_SEP.sub("", m.group()), text.lower())
    return _TOKEN.findall(text)


def plain(token: str) -> str:
    """A token without disguise; numbers become 0; masks stay."""
    if token.isdigit():
        return "0"
    if not token.isascii():
        token = token.translate(_SCRIPTS)
    if not token.isalpha() and sum(c.isalpha() for c in token) * 2 >= len(token) - 1:
        token = token.translate(_LOOKS)
    return _STRETCHED.sub(r"\1", token)


def _keys(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, feature keys) of the single words, pairs, pairs with a gap and triples."""
    u = ids.astype(np.uint64)
    out = []
    m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    mix = lambda h: h ^ (h >> np.uint64(31))
    ok = ids > 0
    p = np.flatnonzero(ok)
    out.append((p, mix(u[p] * m1)))
    if len(ids) > 1:
        p = np.flatnonzero(ok[:-1] & ok[1:])
        out.append((p, mix(u[p] * m1 ^ (u[p + 1] * m2 + np.uint64(1)))))
    if len(ids) > 2:
        p = np.flatnonzero(ok[:-2] & ok[2:] & (ids[1:-1] >= 0))
        out.append((p, mix(u[p] * m1 ^ (u[p + 2] * m3 + np.uint64(2)))))
        p = p[ok[p + 1]]
        out.append((p, mix(mix(u[p] * m1 ^ (u[p + 1] * m2 + np.uint64(3))) * m2 ^ (u[p + 2] * m3))))
    return out


def _blocks(ids: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each position, document of each block, whether the next block continues the sentence)."""
    n = len(ids)
    new = np.ones(n, dtype=bool)
    new[1:] = (ids[:-1] < 0) | (doc_of[1:] != doc_of[:-1])
    starts = np.flatnonzero(new)
    in_sentence = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    cut = new | (in_sentence % BLOCK == 0)
    block = np.cumsum(cut) - 1
    first = np.flatnonzero(cut)
    goes_on = np.zeros(len(first), dtype=bool)
    goes_on[:-1] = ~new[first[1:]]
    return block, doc_of[first], goes_on


class Lexicon:
    """Ids of known words; 0 for others, -1 for sentence ends. Masked words take a flagged word that fits."""

    def __init__(self, words: dict[str, int], flagged: list[str] = ()):
        self.words, self.flagged, self._seen = words, list(flagged), {}

    def __getstate__(self):
        return {"words": self.words, "flagged": self.flagged, "_seen": {}}

    def _resolve(self, token: str) -> int:
        if token in ".!?।\n":
            return -1
        w = plain(token)
        i = self.words.get(w, 0)
        if not i and _MASK.search(token) and any(c.isalpha() for c in token):
            masked = token.translate(_SCRIPTS)
            pattern = re.compile("".join("." if c in "*#_" else re.escape(c.translate(_LOOKS)) for c in masked))
            i = next((self.words[f] for f in self.flagged if pattern.fullmatch(f)), 0)
        return i

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word ids, document number) of all tokens, each document ended by -1."""
        seen, out, sizes = self._seen, [], []
        if len(seen) > 500_000:
            seen.clear()
        for t in texts:
            n = len(out)
            for token in tokens_of(t):
                i = seen.get(token)
                if i is None:
                    i = seen[token] = self._resolve(token)
                out.append(i)
            out.append(-1)
            sizes.append(len(out) - n)
        return np.array(out, dtype=np.int64), np.repeat(np.arange(len(texts)), sizes)


@dataclass
class Chain:
    """Feature keys in order, weights per step, biases and the weights of earlier probabilities.

    The steps are the categories and, last, ``any``: whether the window is of any of them.
    """

    lexicon: Lexicon
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    link: np.ndarray
    threshold: float = 0.5
    facts: dict = field(default_factory=dict)

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(document number, probabilities by step) of each window."""
        return self.windows_of_ids(*self.lexicon.ids(texts))

    def windows_of_ids(self, ids: np.ndarray, doc_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block, doc, goes_on = _blocks(ids, doc_of)
        steps = len(self.bias)
        sums = np.zeros((len(doc), steps))
        for pos, keys in _keys(ids):
            if not len(pos) or not len(self.keys):
                continue
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = np.flatnonzero(self.keys[at] == keys)
            # an n-gram counts once in a window, as in training
            b, a = _distinct(block[pos[hit]], at[hit], len(self.keys))
            nxt = (b > 0) & goes_on[np.maximum(b - 1, 0)]
            b, a = _distinct(np.concatenate([b, b[nxt] - 1]), np.concatenate([a, a[nxt]]), len(self.keys))
            for c in range(steps):
                sums[:, c] += np.bincount(b, self.weights[a, c], len(doc))
        return doc, self.probabilities(sums)

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        p = np.zeros_like(sums)
        for c in range(p.shape[1]):
            p[:, c] = _sigmoid(sums[:, c] + self.bias[c] + p[:, :c] @ self.link[c, :c])
        return p

    def score(self, texts: list[str]) -> np.ndarray:
        """Worst window of each document by category, and for any category (last column)."""
        return self.score_ids(*self.lexicon.ids(texts), len(texts))

    def score_ids(self, ids: np.ndarray, doc_of: np.ndarray, n: int) -> np.ndarray:
        doc, p = self.windows_of_ids(ids, doc_of)
        out = np.zeros((n, p.shape[1]))
        for c in range(p.shape[1]):
            np.maximum.at(out[:, c], doc, p[:, c])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(row: np.ndarray, col: np.ndarray, n_rows: int, n_cols: int, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, may_raise: np.ndarray, rounds: int = 60, l2: float = 0.5):
    """Logistic regression by Adam on binary sparse features (row, col) and dense ``extra`` columns.

    Only features in ``may_raise`` get positive weights. Flagged windows are rare, so they are raised to
    a fifth of the weight of the others while fitting, and the bias is set back to their real share after.
    """
    w, v, b = np.zeros(n_cols), np.zeros(extra.shape[1]), -2.0
    m1, m2 = np.zeros(n_cols + len(v) + 1), np.zeros(n_cols + len(v) + 1)
    up = max(1.0, 0.2 * (weight * (1 - y)).sum() / max(1e-9, (weight * y).sum()))
    weight = weight * np.where(y > 0, up, 1.0)
    total = weight.sum()
    l2 /= total
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col], n_rows) + extra @ v + b
        g = weight * (_sigmoid(z) - y) / total
        grad = np.concatenate([np.bincount(col, g[row], n_cols) + l2 * w, extra.T @ g, [g.sum()]])
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        step = 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-7)
        w -= step[:n_cols]
        np.minimum(w, 0, out=w, where=~may_raise)
        v -= step[n_cols:-1]
        b -= step[-1]
    return w, v, b - np.log(up)


def _chance(a: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Chernoff exponent of seeing a of n documents flagged where a share ``base`` is; 0 below base."""
    r = np.clip(a / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    kl = r * np.log(r / base) + (1 - r) * np.log((1 - r) / (1 - base))
    return np.where(r > base, n * kl, 0.0)


def _not_copies(doc: np.ndarray, keys: np.ndarray, n: int, hashes: int = 24, same: int = 16) -> np.ndarray:
    """False for documents of which an earlier one shares two thirds of the min-hashes of their n-grams.

    Sixteen equal values of twenty-four leave at least four of the twelve neighbouring pairs of values
    whole, so looking documents up by such pairs misses none.
    """
    none = np.iinfo(np.uint64).max
    sig = np.full((n, hashes), none, dtype=np.uint64)
    order = np.argsort(doc, kind="stable")
    doc, keys = doc[order], keys[order]
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
    for k in range(hashes if len(doc) else 0):
        h = (keys ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        sig[doc[starts], k] = np.minimum.reduceat(h, starts)
    keep, seen = np.ones(n, dtype=bool), [dict() for _ in range(hashes // 2)]
    for d in range(n):
        if sig[d, 0] == none:
            continue
        pairs = [(k, tuple(sig[d, 2 * k : 2 * k + 2].tolist())) for k in range(hashes // 2)]
        near = np.unique(np.array([e for k, p in pairs for e in seen[k].get(p, ())], dtype=np.int64))
        if len(near) and ((sig[near] == sig[d]).sum(axis=1) >= same).any():
            keep[d] = False
            continue
        for k, p in pairs:
            seen[k].setdefault(p, []).append(d)
    return keep


@dataclass
class _Sample:
    """Training documents as windows and n-grams; near copies are gone."""

    label: np.ndarray  # of each document: category number, -1 for clean
    doc: np.ndarray  # of each window
    goes_on: np.ndarray  # whether the next window's second half continues the sentence
    block: np.ndarray  # block of each n-gram
    col: np.ndarray  # number of each n-gram
    uniq: np.ndarray  # keys of the n-grams
    doc_col: tuple[np.ndarray, np.ndarray]  # distinct (document, n-gram)

    def counts(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of ``use`` with each n-gram, and the flagged ones of them."""
        d, c = self.doc_col
        n = np.bincount(c[use[d]], minlength=len(self.uniq))
        flagged = use & (self.label >= 0)
        return n, np.bincount(c[flagged[d]], minlength=len(self.uniq))


def _distinct(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(a * np.int64(max(1, n_b)) + b)
    return pair // max(1, n_b), pair % max(1, n_b)


def _select(s: _Sample, use: np.ndarray, rounds: int, alpha: float = 0.02):
    """(windows, rows, features, may raise, hot, weight): the windows worth a model and those taken as flagged.

    Windows without any n-gram that may speak for a flag can never be flagged; they are left to the bias.
    """
    flagged_doc = s.label >= 0
    n_docs, n_pos = s.counts(use)
    base = float(np.clip(flagged_doc[use].mean(), 0.01, 0.99))
    tried = max(2, int((n_docs >= 3).sum()))
    chance = _chance(n_pos, n_docs, base)
    # a seed is beyond chance among all n-grams tried, and in each third of the documents where it occurs
    seed = (chance >= np.log(tried) + np.log(1 / alpha)) & (n_pos >= 0.85 * n_docs)
    third = np.arange(len(use)) * 2654435761 % 2**32 % 3
    occurs = np.zeros(len(seed), dtype=int)
    for k in range(3):
        n, a = s.counts(use & (third == k))
        seed &= a >= 0.6 * n
        occurs += n > 0
    seed &= occurs >= 2
    if not seed.any():  # few labels: the best there is
        seed = (chance >= chance.max(initial=0) * 0.9) & (n_pos >= 2)
    may = seed | ((chance >= 0.5 * np.log(tried)) & (n_pos >= 0.75 * n_docs) & (n_pos >= 2))
    # the windows of these documents that hold such an n-gram
    block_use = use[s.doc]
    has = np.zeros(len(s.doc), dtype=bool)
    has[s.block[may[s.col]]] = True
    window = has.copy()
    window[:-1] |= has[1:] & s.goes_on[:-1]
    window &= block_use
    number = np.full(len(window), -1)
    number[window] = np.arange(int(window.sum()))
    here = number[s.block] >= 0
    prev = (s.block > 0) & s.goes_on[np.maximum(s.block - 1, 0)] & (number[np.maximum(s.block - 1, 0)] >= 0)
    row, col = _distinct(np.concatenate([number[s.block[here]], number[s.block[prev] - 1]]), np.concatenate([s.col[here], s.col[prev]]), len(s.uniq))
    doc = s.doc[window]
    n = len(doc)
    in_flagged = flagged_doc[doc]
    hot = in_flagged & (np.bincount(row, seed[col], n) >= 1)
    rest = float(block_use.sum() - n)  # windows left to the bias: one row without n-grams
    p, weight = np.zeros(n), np.ones(n)
    for _ in range(rounds):
        # only n-grams of at least two documents' hot windows can speak for a flag
        for_flag = np.bincount(_distinct(doc[row[hot[row]]], col[hot[row]], len(s.uniq))[1], minlength=len(s.uniq)) >= 2
        # and n-grams of clean windows that look flagged may speak against it
        like = (p >= 0.02)[row] & ~in_flagged[row]
        against = np.bincount(_distinct(doc[row[like]], col[like], len(s.uniq))[1], minlength=len(s.uniq)) >= 2
        keep = np.flatnonzero((for_flag & may) | against)
        new = np.full(len(s.uniq), -1)
        new[keep] = np.arange(len(keep))
        used = new[col] >= 0
        r, c = row[used], new[col[used]]
        w, _, b = _fit(r, c, n + 1, len(keep), np.zeros((n + 1, 0)), np.append(hot, 0.0), np.append(weight, rest), may[keep])
        p = _sigmoid(np.bincount(r, w[c], n) + b)
        hot = in_flagged & (p >= 0.5)
        weight = np.where(~in_flagged & (p > 0.9), 0.0, 1.0)  # clean by mistake
    return doc, r, c, keep, may[keep], hot, weight, rest, (chance, n_docs, n_pos, tried, int(seed.sum()))


def _chain(s: _Sample, selected: tuple, lexicon: Lexicon, folds: int = 3) -> Chain:
    """Categories one after the other, each seeing the out-of-fold probabilities of the earlier; ``any`` comes last."""
    doc, r, c, keep, may, hot, weight, rest, _ = selected
    n, steps = len(doc), len(CATEGORIES) + 1
    fold = np.append((np.arange(len(s.label)) * 2246822519 % 2**32 % folds)[doc], -1)
    probs, weights, bias, link = np.zeros((n + 1, steps)), np.zeros((len(keep), steps)), np.zeros(steps), np.zeros((steps, steps))
    weight = np.append(weight, rest)
    for k in range(steps):
        y = np.append(hot & (s.label[doc] == k) if k < len(CATEGORIES) else hot, False).astype(float)
        w, v, b = _fit(r, c, n + 1, len(keep), probs[:, :k], y, weight, may)
        weights[:, k], bias[k], link[k, :k] = w, b, v
        for f in range(folds if k + 1 < steps else 0):
            w, v, b = _fit(r, c, n + 1, len(keep), probs[:, :k], y, np.where(fold == f, 0.0, weight), may)
            out = (fold == f) | (fold < 0)
            probs[out, k] = _sigmoid(np.bincount(r, w[c], n + 1) + probs[:, :k] @ v + b)[out]
    return Chain(lexicon, s.uniq[keep], weights, bias, link)


def _best_threshold(score: np.ndarray, flagged: np.ndarray, clean_weight: float, least: float = 0.3, most: float = 0.9) -> float:
    """The middle of the thresholds in [least, most] with the best F1 of these documents."""
    at = np.linspace(least, most, 61)
    said = score[None, :] >= at[:, None]
    hit, wrong = (said & flagged).sum(axis=1), (said & ~flagged).sum(axis=1)
    f1 = 2 * hit / np.maximum(1e-9, hit + clean_weight * wrong + flagged.sum())
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(at[good[len(good) // 2]])


def train(texts: list[str], labels: list[str], *, folds: int = 3, rounds: int = 3, clean_weight: float = 1.0) -> Chain:
    """The chain, from reviewed documents with one label each.

    A label is the document's and may be wrong, so no window of a flagged document is taken on
    trust: it must hold n-grams that go with flagged documents beyond chance (counting all n-grams
    tried), or convince the model fitted on those. The threshold is chosen on documents that the
    n-grams, windows and weights of their fold's model were not chosen on.
    """
    nothing = Chain(Lexicon({}), np.zeros(0, np.uint64), np.zeros((0, 4)), np.full(4, -30.0), np.zeros((4, 4)))
    label = np.array([CATEGORIES.index(x) if x in CATEGORIES else -1 for x in labels])
    if not len(label) or (label >= 0).all() or not (label >= 0).any():
        return nothing
    df: dict[str, int] = {}
    for t in texts:
        for w in {plain(x) for x in set(tokens_of(t))}:
            df[w] = df.get(w, 0) + 1
    words = {w: i + 1 for i, w in enumerate(sorted(w for w, n in df.items() if n >= 2 and w not in ".!?।\n"))}
    ids, doc_of = Lexicon(words).ids(texts)
    block, doc, goes_on = _blocks(ids, doc_of)
    pos, keys = (np.concatenate(x) for x in zip(*_keys(ids)))
    # of copies and near copies only the first counts: their labels are no independent evidence
    first = _not_copies(doc_of[pos], keys, len(texts))
    pos, keys = pos[first[doc_of[pos]]], keys[first[doc_of[pos]]]
    uniq, col = np.unique(keys, return_inverse=True)
    s = _Sample(label, doc, goes_on, block[pos], col, uniq, _distinct(doc_of[pos], col, len(uniq)))
    held = np.zeros(len(texts))
    fold = np.arange(len(texts)) * 2654435761 % 2**32 // 7 % folds
    for f in range(folds):
        use = first & (fold != f)
        if 0 < (label[use] >= 0).sum() < use.sum():
            mine = np.flatnonzero(fold == f)
            held[mine] = _chain(s, _select(s, use, rounds), Lexicon(words)).score_ids(ids, doc_of, len(texts))[mine, -1]
    selected = _select(s, first, rounds)
    chance, n_docs, n_pos, tried, n_seeds = selected[-1]
    # flagged words, for masked ones: single words that speak for a flag, strongest first
    word_keys = _keys(np.arange(1, len(words) + 1))[0][1]
    at = np.searchsorted(uniq, word_keys)
    at[at == len(uniq)] = 0
    names = np.array(list(words), dtype=object)
    speaks = (uniq[at] == word_keys) & (chance[at] >= np.log(tried) / 2) & (n_pos[at] >= 0.6 * n_docs[at])
    order = np.argsort(-chance[at], kind="stable")
    flagged = [names[i] for i in order if speaks[i] and len(names[i]) > 2]
    chain = _chain(s, selected, Lexicon(words, flagged))
    chain.threshold = _best_threshold(held[first], label[first] >= 0, clean_weight)
    said, real = held[first] >= chain.threshold, label[first] >= 0
    chain.facts = {"documents": int(first.sum()), "windows": len(selected[0]), "hot": int(selected[5].sum()), "features": len(chain.keys), "seeds": n_seeds, "flagged_words": flagged[:60]} | {
        "threshold": chain.threshold, "held_out": (int((said & real).sum()), int((said & ~real).sum()), int((~said & real).sum()))
    }
    return chain


def training_rows(documents: DataFrame, labels: DataFrame, *, max_flagged: int, max_clean: int) -> DataFrame:
    """At most so many flagged and clean reviewed documents, chosen by hash of their id."""
    known = labels.select("doc_id", F.lower(F.trim("label")).alias("label")).where(F.col("label").isin("none", *CATEGORIES))
    votes = known.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    serious = F.when(F.col("label") == "none", 0).otherwise(1)
    one = votes.groupBy("doc_id").agg(F.max_by("label", F.struct("n", serious, "label")).alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = one.where("label <> 'none'").orderBy(*by_hash).limit(max_flagged).unionByName(one.where("label = 'none'").orderBy(*by_hash).limit(max_clean))
    joined = documents.select("doc_id", "text").where("text is not null").join(few, "doc_id")
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def trained(rows: DataFrame) -> Chain:
    """The chain trained on (doc_id, text, label), in one task on an executor: the rows are bounded."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *batches]).sort_values("doc_id")
        chain = train(b["text"].tolist(), b["label"].tolist())
        yield pd.DataFrame({"model": [pickle.dumps(chain)]})

    fitted = rows.coalesce(1).mapInPandas(fit, "model binary").first()
    return pickle.loads(fitted.model) if fitted else train([], [])


def score_documents(
    documents: DataFrame, labels: DataFrame, *, max_flagged: int = 1000, max_clean: int = 4000, block: int = 500, keep: tuple = ()
) -> DataFrame:
    """(doc_id, *keep, abuse, hate, sexual, any, flagged) for every document: probability of its worst window.

    ``flagged`` compares ``any`` with the threshold that training chose on held-out documents.
    """
    rows = training_rows(documents, labels, max_flagged=max_flagged, max_clean=max_clean)
    chain = documents.sparkSession.sparkContext.broadcast(trained(rows))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), block):
                part = b.iloc[lo : lo + block]
                s = chain.value.score([t if isinstance(t, str) else "" for t in part["text"]])
                out = part.drop(columns="text")
                for i, c in enumerate((*CATEGORIES, "any")):
                    out[c] = np.round(s[:, i], 6)
                out["flagged"] = s[:, -1] >= chain.value.threshold
                yield out

    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return documents.select("doc_id", *keep, "text").mapInPandas(scan, f"{fields}, abuse double, hate double, sexual double, any double, flagged boolean")


def rates(scores: DataFrame, by: str, threshold: float | None = None) -> DataFrame:
    """Documents and flagged documents for each value of ``by``; without a threshold, as ``flagged`` says."""
    over = lambda c: F.col(c) >= (0.5 if threshold is None else threshold)
    flagged = F.col("flagged") if threshold is None else over("any")
    flags = [F.count_if(flagged & over(c)).alias(f"n_{c}") for c in CATEGORIES]
    return (
        scores.groupBy(by)
        .agg(F.count("*").alias("n_documents"), *flags, F.count_if(flagged).alias("n_any"))
        .withColumn("rate", F.col("n_any") / F.col("n_documents"))
    )

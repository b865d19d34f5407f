"""Operator 5: a quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its features, hashed into BUCKETS rows: words, pairs of neighbouring
words (one and the same pair for any word that follows itself) and runs of NGRAM letters inside words. A softmax layer
on the average gives the classes; vectors and layer are trained together by numpy stochastic gradient descent, one
document at a time. As all is linear up to the softmax, a feature's share of the logit is worked out once, and scoring
is one table look-up for each feature of the whole text.

Labels come from a bounded sample (PER_CLASS rows a class). Nulls and empty texts have no features and score the layer's
bias; without usable labels, or with one class only, every score is the (smoothed) share of class 1, and `accepted`, which
cannot judge then, keeps all rows. Repeated rows score alike. An empty table gives no rows. Columns of any name pass
through `accepted`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix
from .supervised import collect_features, score, training_sample

MODULUS, HELD, THRESHOLD = 4, 2, 0.7
BUCKETS, DIM, NGRAM, PER_CLASS, EPOCHS, RATE = 1 << 17, 12, 4, 1500, 8, 40.0

_U = np.uint64


def _blank(x: np.ndarray) -> np.ndarray:
    return (x == 0x20) | (x >= 0x09) & (x <= 0x0D)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Feature numbers of each text: its words, pairs of neighbouring words, and runs of NGRAM letters inside words."""
    low = lambda h: (h & _U(BUCKETS - 1)).astype(np.int32)
    w = Words(texts)
    words, owner = w.hashes(), w.doc()
    found, docs = [low(words)], [owner]
    if len(words) > 1:
        same = owner[1:] == owner[:-1]
        second = np.where(words[1:] == words[:-1], _U(1), words[1:])  # a pair of the same word is one feature whatever the word
        first = np.where(words[1:] == words[:-1], _U(1), words[:-1])
        found.append(low(mix(first * _U(3) + second, 7))[same])
        docs.append(owner[1:][same])
    # Letters are code points; blanks in a row are one, and a run may begin or end with it but not go across it.
    strings = [t.decode("utf-8", "replace") for t in texts]
    x = np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("utf-32-le"), np.uint32)
    blank = _blank(x)
    kept = np.flatnonzero(~(blank & np.concatenate(([False], blank[:-1]))))
    letters, blank = np.where(blank, 0x20, x)[kept].astype(_U), blank[kept]
    n = len(letters) - NGRAM + 1
    if n > 0:
        h, inside = np.zeros(n, _U), np.ones(n, bool)
        for k in range(NGRAM):
            h = h * _U(0x9E3779B97F4A7C15) + letters[k : k + n]
            if 0 < k < NGRAM - 1:
                inside &= ~blank[k : k + n]
        at = np.flatnonzero(inside)
        begins = np.cumsum(np.concatenate(([1], np.fromiter(map(len, strings), np.int64, len(strings)) + 1)))
        found.append(low(mix(h[at], 3)))
        docs.append(np.searchsorted(begins, kept[at + 1], "right") - 1)
    every, doc = np.concatenate(found), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    return [every[order[a:z]] for a, z in zip(cuts[:-1], cuts[1:])]


def train(rows: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """(logit share of each feature, bias)."""
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = [(c / c.sum()).astype(np.float32) if len(c) else c.astype(np.float32) for c in counts]
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            rate = 1 - done / steps
            done += 1
            f, x = rows[i], weight[i]
            hidden = x @ vectors[f] if len(f) else np.zeros(DIM, np.float32)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ layer
            layer -= np.float32(0.5 * rate) * np.outer(p, hidden)
            bias -= np.float32(0.05 * rate) * p
            if len(f):
                vectors[f] -= np.float32(RATE * rate) * np.outer(x, back)
    seen = np.zeros(BUCKETS, bool)
    for f in rows:
        seen[f] = True
    shares = vectors @ (layer[1] - layer[0])
    shares[~seen] = 0
    return shares.astype(np.float32), float(bias[1] - bias[0])


def logits(model: tuple[np.ndarray, float], texts: list[bytes]) -> list[float]:
    shares, bias = model
    return [bias + (float(shares[f].mean(dtype=np.float64)) if len(f) else 0.0) for f in features(texts)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    return train(*collect_features(training_sample(docs, labels, "quality", MODULUS, HELD, per_class), features))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels, per_class), logits, MODULUS, HELD, threshold)
    return found.select("_row.doc_id", "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of docs, for the documents that the classifier accepts; all of them if the labels hold no two classes."""
    rows, counts, y = collect_features(training_sample(docs, labels, "quality", MODULUS, HELD, per_class), features)
    if len(set(y.tolist())) < 2:
        return docs
    found = score(docs, train(rows, counts, y), logits, MODULUS, HELD, threshold)
    return found.where("predicted = 1").select(*[F.col(f"_row.`{n}`").alias(n) for n in docs.columns])

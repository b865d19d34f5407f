"""Operator 1: toxicity by a factorization machine over hashed terms.

Terms are the letter runs of a text, A-Z lower-cased: each word and its leading PREFIXES bytes (for stems that take
endings), hashed into BUCKETS. With x = 1 for the terms a text holds, the machine is
    y(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,
so that two terms can say together what neither says alone, such as an insult and the mention of a group. The pair sum is
taken as half of |sum v|^2 - sum |v|^2. Weights are learned by numpy AdaGrad on the logistic loss from a bounded sample
(PER_CLASS rows a class). A term takes part if its presence tells of the class (a likelihood-ratio statistic of MIN_G2 or
more) or if it does so with another term only (the same for the four cases of two terms, PAIR_G2 or more above what each
tells alone; PAIR_TERMS terms are looked at). All others stay at zero: in long texts, the sum over thousands of them
would drown the few that matter.

Nulls and empty texts have no terms and score w0. Without usable labels, or with one class only, every score is the
(smoothed) share of class 1. Repeated rows score alike. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import Words
from .supervised import collect_features, score, training_sample

MODULUS, HELD, THRESHOLD = 3, 1, 0.7
BUCKETS, DIM, PREFIXES = 1 << 20, 4, (4, 5, 6)
PER_CLASS, MIN_G2, EPOCHS, RATE, DECAY, START, CLASS_WEIGHT = 3000, 14.0, 30, 0.3, 1e-5, 0.1, 20.0
PAIR_TERMS, PAIR_SHARE, PAIR_G2 = 1000, 0.01, 60.0

_U = np.uint64
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms and the text number of each."""
    doc, sums = w.doc(), w.prefix_sums()
    cut = lambda h: (h & _U(BUCKETS - 1)).astype(np.int32)
    out, docs = [cut(w.hashes(sums))], [doc]
    for n in PREFIXES:
        long = w.ends - w.starts > n
        out.append(cut(w.hashes(sums, w.starts[long] + n, w.starts[long]) ^ _U(n * 0x9E3779B9)))
        docs.append(doc[long])
    return np.concatenate(out), np.concatenate(docs)


def features(texts: list[bytes]) -> list[np.ndarray]:
    w = Words(texts, _LETTERS, lower=True)
    f, doc = terms(w)
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(w.n + 1))
    return [f[order[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]


class Machine:
    """Weights of the terms in use: `place` maps a bucket to a row of w and v, row 0 being all others (zero)."""

    def __init__(self, w0: float, buckets: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.w0, self.buckets, self.w, self.v = w0, buckets, w, v

    def logits(self, texts: list[bytes]) -> np.ndarray:
        place = np.zeros(BUCKETS, np.int32)
        place[self.buckets] = np.arange(1, len(self.buckets) + 1)
        f, doc = terms(Words(texts, _LETTERS, lower=True))
        rows = place[f]
        known = rows > 0
        pair = np.unique(doc[known].astype(np.int64) << 32 | rows[known])  # each term of a text once
        doc, rows = pair >> 32, (pair & 0xFFFFFFFF) - 1
        n, out = len(texts), np.full(len(texts), self.w0)
        out += np.bincount(doc, self.w[rows], n)
        for k in range(self.v.shape[1]):
            v = self.v[rows, k]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def _g2(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of (term present, class) against independence, for each bucket."""
    tally = lambda own: np.bincount(np.concatenate(own), minlength=BUCKETS).astype(float)
    one, zero = (tally([f for f, t in zip(rows, y) if t == c]) for c in (1, 0))
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    both = one + zero
    g2 = np.zeros(BUCKETS)
    for seen, size, present in ((one, n1, both), (zero, n0, both), (n1 - one, n1, n1 + n0 - both), (n0 - zero, n0, n1 + n0 - both)):
        expected = present * size / (n1 + n0)
        g2 += 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))
    return g2


def _log_ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))


def _in_pairs(rows: list[np.ndarray], y: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Buckets of terms that tell of the class only together with another: the same ratio for the four cases of two
    terms, less what each tells alone, is PAIR_G2 or more. Looks at the PAIR_TERMS terms nearest to half of the texts
    among those in PAIR_SHARE of them or more; all pairs of these are tallied by one matrix product for each class."""
    n = len(y)
    held = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    often = np.flatnonzero((held >= PAIR_SHARE * n) & (held <= (1 - PAIR_SHARE) * n))
    often = np.sort(often[np.argsort(np.abs(held[often] - n / 2), kind="stable")][:PAIR_TERMS])
    if len(often) < 2:
        return np.zeros(0, np.int64)
    place = np.full(BUCKETS, -1, np.int64)
    place[often] = np.arange(len(often))
    x = np.zeros((n, len(often)), np.float32)
    for i, f in enumerate(rows):
        p = place[f]
        x[i, p[p >= 0]] = 1
    total = np.zeros((len(often), len(often)))
    shares = y.sum() / n, 1 - y.sum() / n
    by_class = [x[y == c] for c in (1, 0)]
    both = [(part.T @ part).astype(float) for part in by_class]
    ones = [part.sum(axis=0).astype(float) for part in by_class]
    for at, (pair, one, part) in enumerate(zip(both, ones, by_class)):
        other, lone, size = both[1 - at], ones[1 - at], len(part)
        cells = ((pair, pair + other), (one[:, None] - pair, (one + lone)[:, None] - pair - other), (one[None, :] - pair, (one + lone)[None, :] - pair - other), (size - one[:, None] - one[None, :] + pair, n - (one + lone)[:, None] - (one + lone)[None, :] + pair + other))
        for seen, all_seen in cells:
            total += _log_ratio(seen, all_seen * shares[at])
    alone = _g2(rows, y)[often]
    gain = total - alone[:, None] - alone[None, :]
    np.fill_diagonal(gain, 0)
    found = often[(gain >= PAIR_G2).any(axis=1)]
    return np.setdiff1d(found, taken)


def train(rows: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, seed: int = 1) -> Machine:
    """counts aren't used: a text holds a term or doesn't. The rarer class weighs more, up to CLASS_WEIGHT times."""
    del counts
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int32)
    if len(set(y.tolist())) < 2:
        return Machine(prior, none, np.zeros(0), np.zeros((0, DIM)))
    buckets = np.flatnonzero(_g2(rows, y) >= MIN_G2)
    buckets = np.sort(np.concatenate((buckets, _in_pairs(rows, y, buckets)))).astype(np.int32)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    data = [p[p >= 0] for p in (place[f] for f in rows)]
    rng = np.random.default_rng(seed)
    weight = np.clip(np.array([y.mean(), 1 - y.mean()]) / np.array([1 - y.mean(), y.mean()]), 1, CLASS_WEIGHT)
    w0, w, v = 0.0, np.zeros(len(buckets)), rng.normal(0, START, (len(buckets), DIM))
    gw, gv, g0 = np.full(len(buckets), 1e-8), np.full((len(buckets), DIM), 1e-8), 1e-8
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            f = data[i]
            own = v[f]
            total = own.sum(axis=0)
            z = w0 + w[f].sum() + 0.5 * ((total**2).sum() - (own**2).sum())
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[y[i]]
            g0 += slope * slope
            w0 -= RATE * slope / np.sqrt(g0)
            step = slope + DECAY * w[f]
            gw[f] += step * step
            w[f] -= RATE * step / np.sqrt(gw[f])
            step = slope * (total - own) + DECAY * own
            gv[f] += step * step
            v[f] -= 0.1 * RATE * step / np.sqrt(gv[f])
    return Machine(w0, buckets, w, v)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    return train(*collect_features(training_sample(docs, labels, "toxic", MODULUS, HELD, per_class), features))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = score(docs.select("doc_id", "text"), fit(docs, labels, per_class), Machine.logits, MODULUS, HELD, threshold)
    return found.select("_row.doc_id", "held_out", "score", "predicted")

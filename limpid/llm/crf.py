"""A two-state linear-chain random field over words, in vectorised numpy.

State 1 is "toxic". A word's emission is the weight sum of its features, and
the recursions run on odds: ``r[t] = alpha[t](1) / alpha[t](0)`` is a fraction
of linear terms in ``r[t-1]``, so a run of words composes to one 2x2 matrix.
All texts of a batch lie behind each other; a text's first word maps any odds
to a constant, which cuts the chains. The batch is cut into a few times sqrt(n) runs,
the runs are composed side by side, and the odds are then carried from run to run.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

FEATURE_SPACE = 1 << 18
PREFIXES = (3, 4, 5)


def word_features(word: str) -> list[int]:
    """Hashed features: the word, its first 3, 4 and 5 letters, its last 3."""
    seen = [f"w{word}"] + [f"p{word[:k]}" for k in PREFIXES if len(word) > k]
    if len(word) > 3:
        seen.append(f"s{word[-3:]}")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURE_SPACE for x in seen]


@dataclass
class Model:
    """Feature weights, log transitions [from][to], log odds of the first state, document calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURE_SPACE, dtype=np.float32))
    transitions: tuple[float, float, float, float] = (0.0, -2.0, 0.0, -1.0)
    start: float = -4.0
    bias: float = -4.0
    calibration: tuple[float, float, float] = (0.0, 1.0, 0.0)

    def emission(self, word: str) -> float:
        return self.bias + float(sum(self.weights[i] for i in word_features(word)))


def _compose(mats: np.ndarray) -> np.ndarray:
    """Odds after every step, the first run entered with odds 1. ``mats``: steps x 2 x 2, as (num, den) rows of (1, r)."""
    n = len(mats)
    width = max(1, int(np.sqrt(n) / 4))
    runs = -(-n // width)
    full = np.zeros((runs * width, 2, 2))
    full[:, 0, 1] = full[:, 1, 0] = 1.0  # the rest: odds stay (num = r, den = 1)
    full[:n] = mats
    m = np.ascontiguousarray(full.reshape(runs, width, 2, 2).transpose(1, 2, 3, 0))
    # odds as a fraction num/den of homogeneous coordinates (den first): v' = B v, v = (den, num)
    a, b, c, d = np.ones(runs), np.zeros(runs), np.zeros(runs), np.ones(runs)
    for t in range(width):
        n0, n1, d0, d1 = m[t, 0, 0], m[t, 0, 1], m[t, 1, 0], m[t, 1, 1]
        a, b, c, d = d0 * a + d1 * c, d0 * b + d1 * d, n0 * a + n1 * c, n0 * b + n1 * d
        scale = 1.0 / np.maximum(np.maximum(np.abs(a), np.abs(b)), np.maximum(np.maximum(np.abs(c), np.abs(d)), 1e-300))
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    enter, r = np.empty(runs), 1.0
    for k in range(runs):
        enter[k] = r
        den = a[k] + b[k] * r
        r = min(max((c[k] + d[k] * r) / max(den, 1e-300), 1e-30), 1e30)
    out, r = np.empty((width, runs)), enter
    for t in range(width):
        r = np.clip((m[t, 0, 0] + m[t, 0, 1] * r) / np.maximum(m[t, 1, 0] + m[t, 1, 1] * r, 1e-300), 1e-30, 1e30)
        out[t] = r
    return out.T.reshape(-1)[:n]


def odds(emissions: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of every word. ``first`` marks the first word of each text."""
    n = len(emissions)
    a00, a01, a10, a11 = np.exp(model.transitions)
    e = np.exp(np.clip(emissions, -30, 30))
    fwd = np.empty((n, 2, 2))
    fwd[:, 0, 0], fwd[:, 0, 1], fwd[:, 1, 0], fwd[:, 1, 1] = e * a01, e * a11, a00, a10
    fwd[first, 0, 0], fwd[first, 0, 1] = e[first] * np.exp(model.start), 0.0
    fwd[first, 1, 0], fwd[first, 1, 1] = 1.0, 0.0
    r = _compose(fwd)
    # backward: step t turns the odds of t+1 into those of t; a text's last word has odds 1
    last = np.append(first[1:], True)
    nxt = np.append(e[1:], 1.0)
    bwd = np.empty((n, 2, 2))
    bwd[:, 0, 0], bwd[:, 0, 1], bwd[:, 1, 0], bwd[:, 1, 1] = a10, a11 * nxt, a00, a01 * nxt
    bwd[last, 0, 0], bwd[last, 0, 1], bwd[last, 1, 0], bwd[last, 1, 1] = 1.0, 0.0, 1.0, 0.0
    return r, _compose(bwd[::-1])[::-1]


def marginals(emissions: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Probability of state 1 at every word."""
    if not len(emissions):
        return np.zeros(0)
    r, q = odds(emissions, first, model)
    x = np.clip(r * q, 1e-300, 1e300)
    return x / (1.0 + x)


def document_features(p: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: 1, log odds that any word is toxic, log of expected toxic words. Empty texts: lowest values."""
    out = np.tile(np.array([1.0, -12.0, 0.0]), (len(counts), 1))
    full = counts > 0
    if full.any():
        at = starts[full]
        none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), at)
        out[full, 1] = np.clip(np.log(np.maximum(-np.expm1(none), 1e-9)) - none, -12.0, 12.0)
        out[full, 2] = np.log1p(np.add.reduceat(p, at))
    return out


def document_scores(features: np.ndarray, model: Model) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(features @ np.array(model.calibration), -35, 35)))


def layout(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word types behind each other, marks of first words, and each text's start and count."""
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
    flat = np.fromiter((x for d in docs for x in d), dtype=np.int64, count=int(counts.sum()))
    first = np.zeros(len(flat), dtype=bool)
    first[starts[counts > 0]] = True
    return flat, first, starts, counts


def _adagrad(grad: np.ndarray, seen: np.ndarray, rate: float) -> np.ndarray:
    seen += grad * grad
    return rate * grad / np.sqrt(seen + 1e-8)


def without_near_copies(docs: list[list[str]], labels: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
    """Leave out texts that share one of four min-hashes of their word pairs with an earlier text.

    Words of one text that was copied many times would otherwise look typical of its label.
    """
    kept, seen = [], set()
    for i, d in enumerate(docs):
        pairs = np.array([zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(d, d[1:])] or [zlib.crc32(" ".join(d).encode("utf-8", "surrogatepass"))], dtype=np.uint64)
        own = {(k, int(((pairs * np.uint64(mul)) & np.uint64(0xFFFFFFFF)).min())) for k, mul in enumerate((1, 2654435761, 2246822519, 3266489917))}
        if not own & seen:
            kept.append(i)
            seen |= own
    return [docs[i] for i in kept], labels[kept]


def fit_chain(docs: list[list[str]], toxic: np.ndarray, steps: int, min_lift: float = 6.0) -> Model:
    """Learn the chain from labelled texts.

    Labelled words: in a text marked toxic, a word is toxic if one of its
    features has ``min_lift`` times the odds to stand in toxic rather than clean
    texts, beyond what chance gives over as many features; all other words, and
    all words of clean texts, are clean.
    """
    if not docs or not toxic.any() or toxic.all():
        return Model(bias=-12.0)
    vocab: dict[str, int] = {}
    flat, first, starts, counts = layout([[vocab.setdefault(w, len(vocab)) for w in d] for d in docs])
    if not len(flat):
        return Model(bias=-12.0)
    feats = [word_features(w) for w in vocab]
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    fid = np.fromiter((x for f in feats for x in f), dtype=np.int64, count=len(owner))
    doc_of = np.repeat(np.arange(len(docs)), counts)
    # a place counts once for each pair of neighbours, so that words of a copied passage count once
    before, after = np.where(first, -1, np.append(-1, flat[:-1])), np.where(np.append(first[1:], True), -1, np.append(flat[1:], -1))
    in_toxic, in_clean = np.zeros(FEATURE_SPACE), np.zeros(FEATURE_SPACE)
    for rows, into in ((toxic[doc_of], in_toxic), (~toxic[doc_of], in_clean)):
        places = np.unique(np.stack([flat[rows], before[rows], after[rows]]), axis=1)[0]
        into += np.bincount(fid, weights=np.bincount(places, minlength=len(vocab))[owner], minlength=FEATURE_SPACE)
    n1, n0 = in_toxic.sum(), in_clean.sum()
    n = in_toxic + in_clean
    share, prior = (in_toxic + 1e-9) / (n + 2e-9), n1 / (n1 + n0)
    lift = share / (1 - share + 0.5 / (n + 1)) / (prior / (1 - prior))
    # log of the chance that unrelated places fall like this (Chernoff), over all features tried
    surprise = n * (share * np.log(share / prior) + (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - prior)))
    marks = (lift >= min_lift) & (surprise >= np.log(10.0 * max((n > 0).sum(), 1)))
    marked_word = np.bincount(owner, weights=marks[fid], minlength=len(vocab)) > 0
    y = marked_word[flat] & toxic[doc_of]

    weights, seen_w = np.zeros(FEATURE_SPACE), np.zeros(FEATURE_SPACE)
    base = np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0))
    bias, trans, start = np.array([base]), np.array([0.0, base / 2, 0.0, 0.0]), np.array([base / 2])
    seen_b, seen_t, seen_s = np.zeros(1), np.zeros(4), np.zeros(1)
    prev, cur = np.flatnonzero(~first) - 1, np.flatnonzero(~first)
    observed = np.bincount(2 * y[prev] + y[cur], minlength=4).astype(float)
    y1, scale = y.astype(float), 1.0 / len(y)
    for _ in range(steps):
        model = Model(transitions=tuple(trans), start=float(start[0]), bias=float(bias[0]))
        emit = (np.bincount(owner, weights=weights[fid], minlength=len(vocab)) + bias[0])[flat]
        r, q = odds(emit, first, model)
        x = np.clip(r * q, 1e-300, 1e300)
        p = x / (1 + x)
        gap = np.bincount(flat, weights=y1 - p, minlength=len(vocab))
        grad = np.bincount(fid, weights=gap[owner], minlength=FEATURE_SPACE) - 0.5 * weights
        e = np.exp(np.clip(emit[cur], -30, 30)) * np.clip(q[cur], 1e-30, 1e30)
        a, rp = np.exp(trans), r[prev]
        joint = np.stack([a[0] * np.ones_like(rp), a[1] * e, a[2] * rp, a[3] * rp * e])
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        weights += _adagrad(grad, seen_w, 0.5)
        bias += _adagrad(np.array([(y1 - p).sum()]) * scale, seen_b, 0.1)
        step = _adagrad((observed - expected) * scale, seen_t, 0.1)
        trans += step - step[[0, 0, 2, 2]]  # leaving odds only: each row's first entry stays 0
        start += _adagrad(np.array([(y1[first] - p[first]).sum()]) * scale, seen_s, 0.1)
    return Model(weights.astype(np.float32), tuple(float(x) for x in trans), float(start[0]), float(bias[0]))


def score_words(docs: list[list[str]], model: Model) -> np.ndarray:
    cache: dict[str, float] = {}
    vocab: dict[str, int] = {}
    flat, first, starts, counts = layout([[vocab.setdefault(w, len(vocab)) for w in d] for d in docs])
    emit = np.array([cache.setdefault(w, model.emission(w)) for w in vocab] or [0.0])
    return document_features(marginals(emit[flat], first, model), starts, counts)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.01 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return tuple(float(b) for b in beta)


def fit(docs: list[list[str]], toxic: np.ndarray, toxic_share: float, steps: int = 30) -> Model:
    """Chain on all texts; document calibration on scores of texts that the scoring chain has not seen."""
    docs, toxic = without_near_copies(docs, toxic.astype(bool))
    model = fit_chain(docs, toxic, steps)
    if not docs or not toxic.any() or toxic.all():
        return Model(bias=-12.0, calibration=(-4.0 if not toxic.any() else 4.0, 0.0, 0.0))
    fold = np.arange(len(docs)) % 2 == 0
    x = np.zeros((len(docs), 3))
    for part in (fold, ~fold):
        other = fit_chain([d for d, k in zip(docs, part) if not k], toxic[~part], steps)
        x[part] = score_words([d for d, k in zip(docs, part) if k], other)
    share = toxic.mean()
    weight = np.where(toxic, toxic_share / share, (1 - toxic_share) / (1 - share))
    model.calibration = calibrate(x, toxic.astype(float), weight)
    return model

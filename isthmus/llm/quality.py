"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Vote patterns (at most 3^8) are counted over all
documents, and expectation-maximisation estimates from the counts how often each labeller votes so on good and on bad
texts, without any given label. Labellers overlap: several see the same kind of bad text and none sees all kinds. So bad
texts are a mixture of as many kinds as there are labellers, within which votes are independent; what is known of a
labeller on bad texts is its mean over the kinds. The posterior labels then train a hashed linear scorer of token shapes,
fitted on a bounded hash sample of `fit_rows` documents, which judges every document.

Defined results: a null text or one without tokens gets no votes and the score of a text without features, that of the
prior; ties at the threshold are kept; repeated rows get equal scores; very long texts and tokens are read whole; an empty
table fits nothing and gives no rows; other columns pass through `keep_good` unread.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import col, per_batch

BUCKETS = 1 << 12
#: Very common function words of the corpus languages.
FUNCTION_WORDS = frozenset("the of and to in that is was for it with as on be at by this are or from an not de la le et les des en un une que qui dans pour est sur der die und das den von zu mit ist im nicht ein eine sich dem el los las por con para se y al del su".split())

_SHAPES: dict[str, int] = {}
_NOT_PLAIN = re.compile(r"[^\w\s.,;:!?'\"()|\-]+")


def shape(token: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are, repeats once."""
    out: list[str] = []
    for c in token:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _vote(share: float, good: float, bad: float) -> int:
    return 1 if share <= good else 2 if share >= bad else 0


class Look:
    """Counts over a text's tokens that labellers and features share."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.tokens = self.text.split()
        self.n = len(self.tokens)
        t = self.tokens
        self.same = sum(map(str.__eq__, t, t[1:]))
        self.counts = Counter(t)


def separators(x: Look) -> int:
    return _vote(sum(c for t, c in x.counts.items() if len(t) < 4 and not any(map(str.isalnum, t))) / x.n, 0.02, 0.1)


def repetition(x: Look) -> int:
    return _vote(x.same / x.n, 0.05, 0.2)


def symbols(x: Look) -> int:
    return _vote(len(_NOT_PLAIN.findall(x.text)) / x.n, 0.02, 0.1)


def capitals(x: Look) -> int:
    return _vote(sum(c for t, c in x.counts.items() if t.isupper() and len(t) > 1) / x.n, 0.1, 0.4)


def shouting(x: Look) -> int:
    return _vote((x.text.count("!!") + x.text.count("??")) / x.n, 0.01, 0.1)


def monotony(x: Look) -> int:
    return 0 if x.n < 20 else _vote(max(x.counts.values()) / x.n, 0.2, 0.4)


def repeated_lines(x: Look) -> int:
    lines = [s for s in x.text.split("\n") if s]
    return 0 if len(lines) < 4 else _vote(1 - len(set(lines)) / len(lines), 0.1, 0.4)


def function_words(x: Look) -> int:
    return 0 if x.n < 20 else _vote(-sum(x.counts[w] for w in FUNCTION_WORDS if w in x.counts) / x.n, -0.08, -0.01)


LABELLERS: tuple[Callable[[Look], int], ...] = (separators, repetition, symbols, capitals, shouting, monotony, repeated_lines, function_words)


def pattern(x: Look) -> int:
    """The votes (0 none, 1 good, 2 bad) as digits to base 3."""
    code = 0
    for f in reversed(LABELLERS):
        code = code * 3 + (f(x) if x.n else 0)
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 300, strength: float = 0.01, false_alarm: float = 0.002, own: float = 0.9, other: float = 0.05, good: float = 0.9) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over pattern counts: P(vote | class) as (class, labeller, vote), P(good), and P(good | pattern).

    Abstentions say nothing about the class. Beta priors say which class is which: bad votes have mean `false_alarm` on
    good texts, `own` on the kind that a labeller was made for and `other` on the rest. They weigh as much as `strength`
    times the documents (10 at least) for the good class, and the same divided among the kinds, so the estimates are those
    of the data. As many more texts are taken to be good by a share of `good`.
    """
    n = len(LABELLERS)
    votes = votes_of(codes)
    bad, cast = votes == 2, votes > 0
    mean = np.full((n + 1, n), other)
    mean[0], mean[np.arange(1, n + 1), np.arange(n)] = false_alarm, own
    whole = max(strength * counts.sum(), 10.0)
    weight, more = whole * np.r_[1.0, np.full(n, 1 / n)][:, None], whole * np.r_[good, np.full(n, (1 - good) / n)]
    share = np.c_[np.where(bad.any(1), 0.05, 0.95), np.zeros((len(codes), n))]
    share[:, 1:] = (1 - share[:, :1]) * np.where(bad.any(1)[:, None], bad / np.maximum(bad.sum(1, keepdims=True), 1), 1 / n)
    for _ in range(rounds):
        mass = share * counts[:, None]
        prior = (mass.sum(0) + more) / (mass.sum() + whole)
        rate = (mass.T @ bad + weight * mean) / (mass.T @ cast + weight)
        logs = np.log(prior) + bad @ np.log(rate).T + (cast & ~bad) @ np.log1p(-rate).T
        after = np.exp(logs - logs.max(1, keepdims=True))
        after /= after.sum(1, keepdims=True)
        done = np.abs(after - share).max() < 1e-9
        share = after
        if done:
            break
    kinds = prior[1:] / prior[1:].sum()
    table = np.zeros((2, n, 3))
    table[:, :, 2] = kinds @ rate[1:], rate[0]
    table[:, :, 1] = 1 - table[:, :, 2]
    return table, float(prior[0]), share[:, 0]


def features(x: Look) -> dict[int, float]:
    """Hashed token shapes, and a token equal to the one before, by their share of the tokens: once full at a fifth, once at a fiftieth."""
    if not x.n:
        return {}
    if len(_SHAPES) > 200_000:
        _SHAPES.clear()
    total: Counter = Counter()
    for t, c in x.counts.items():
        if (b := _SHAPES.get(t)) is None:
            b = zlib.crc32(shape(t).encode("utf-8", "surrogatepass")) % BUCKETS & ~1
            if len(t) <= 64:
                _SHAPES[t] = b
        total[b] += c
    total[zlib.crc32(b" same") % BUCKETS & ~1] += x.same
    total[zlib.crc32(b" top") % BUCKETS & ~1] += max(x.counts.values()) if x.n >= 20 else 0
    out = {}
    for b, c in total.items():
        if c:
            out[b], out[b | 1] = min(1.0, 5 * c / x.n), min(1.0, 50 * c / x.n)
    return out


def fit_linear(rows: list[dict[int, float]], target: np.ndarray, penalty: float = 1e-3, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps on sparse rows; the last weight is the intercept."""
    n = len(rows)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    used, column = np.unique(np.array([b for r in rows for b in r], int), return_inverse=True)
    value = np.array([v for r in rows for v in r.values()], float)
    d = len(used)
    w, before = np.zeros(d + 1), np.zeros(d + 1)
    step = 4 / (1 + np.bincount(row, value * value, n).max(initial=0.0))
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        z = np.bincount(row, value * ahead[column], n) + ahead[d]
        miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        slope = np.r_[np.bincount(column, value * miss[row], d) / n + penalty * ahead[:d], miss.mean()]
        before, w = w, ahead - step * slope
    out = np.zeros(BUCKETS + 1)
    out[used], out[BUCKETS] = w[:d], w[d]
    return out


class QualityModel:
    """Weights of the linear scorer, and posterior labels by vote pattern."""

    def __init__(self, weights: np.ndarray, posterior: dict[int, float], labellers: dict[str, dict[str, float]]) -> None:
        self.weights, self.posterior, self.labellers = weights, posterior, labellers

    def score(self, x: Look) -> float:
        z = float(self.weights[BUCKETS]) + sum(float(self.weights[b]) * v for b, v in sorted(features(x).items()))
        return 1 / (1 + float(np.exp(-min(max(z, -50.0), 50.0))))


def fit_quality(docs: DataFrame, fit_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Count vote patterns over all documents, estimate the labellers, and train the scorer on about fit_rows documents, chosen by a hash of id and text."""
    counted = per_batch(docs, [text], lambda texts: {"code": [pattern(Look(t)) for t in texts]}, "code long").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counted:
        return QualityModel(np.zeros(BUCKETS + 1), {}, {})
    counted.sort()
    codes, counts = np.array([r[0] for r in counted]), np.array([r[1] for r in counted], float)
    table, _, good = estimate(codes, counts)
    posterior = dict(zip(codes.tolist(), good.tolist(), strict=True))
    part = min(1.0, fit_rows / counts.sum())
    sample = docs.where(F.pmod(F.xxhash64(col(doc_id), col(text)), F.lit(1 << 31)) < int(part * (1 << 31)))

    def look(texts: list) -> dict:
        looks = [Look(t) for t in texts]
        found = [sorted(features(x).items()) for x in looks]
        return {"code": [pattern(x) for x in looks], "b": [[b for b, _ in f] for f in found], "v": [[v for _, v in f] for f in found]}

    rows = per_batch(sample, [text], look, "code long, b array<int>, v array<float>", _SHAPES.clear).collect()
    rows.sort(key=lambda r: (r.code, r.b, r.v))  # so that sums don't depend on the order of files
    weights = fit_linear([dict(zip(r.b, r.v, strict=True)) for r in rows], np.array([posterior.get(r.code, 0.5) for r in rows])) if rows else np.zeros(BUCKETS + 1)
    accuracy = {f.__name__: {"good votes on good": float(table[1, k, 1]), "bad votes on bad": float(table[0, k, 2])} for k, f in enumerate(LABELLERS)}
    return QualityModel(weights, posterior, accuracy)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, weak_label (posterior that the votes alone give), score, keep."""

    def judge(ids: list, texts: list) -> dict:
        looks = [Look(t) for t in texts]
        scores = [round(model.score(x), 6) for x in looks]
        return {"doc_id": ids, "weak_label": [round(model.posterior.get(pattern(x), 0.5), 6) for x in looks], "score": scores, "keep": [s >= threshold for s in scores]}

    return per_batch(docs, [doc_id, text], judge, "doc_id long, weak_label double, score double, keep boolean", _SHAPES.clear)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The documents that the scorer doesn't reject, unchanged."""

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield pd.Series([round(model.score(Look(t if isinstance(t, str) else None)), 6) >= threshold for t in texts], dtype=bool)
        finally:
            _SHAPES.clear()

    return docs.where(good(col(text)))

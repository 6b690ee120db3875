"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w x - c_k) with one weight vector for all ordered thresholds c_1 < c_2 < ...; the expected
severity is the sum of these probabilities. Features are hashed words and beginnings of words, present or not, chosen by
their counts over all labelled documents: each that occurs so much oftener in toxic ones that chance doesn't explain it,
however small its share of them, so that words of rare languages and kinds count as well.

Given labels only say toxic or not. Grades of toxic documents come from held-out evidence: documents are split in two
halves by a hash of their id, and a document's evidence is the sum of the log-odds that its words have in the other half,
divided by the logarithm of its number of words. The thirds of this evidence, within a language if a language column is
given, are grades 1, 2 and 3; without evidence the grade is 1. So no grade is made from the counts that it is predicted by.
As these grades are uncertain and the labels aren't, grades have a tenth of the weight in the likelihood (`trust`), toxic
or not the rest.

Defined results: a null or wordless text has no features and gets the severity of the thresholds alone; labels that are
null don't count, a document labelled twice is toxic if one label says so; without labels of both kinds nothing is
learned and every severity is 0; repeated rows get equal results; very long texts are read whole; an empty table gives no
rows; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut_lineage, stored
from .text import arrow_schema, col, fold_words, per_batch, pieces

BUCKETS, GRADES = 1 << 20, 3
#: Lengths in bytes of the beginnings of longer words.
BEGINNINGS = (4, 5, 6, 7, 8)


def buckets(text: str | None) -> set[int]:
    """Buckets of a text's words (even) and of their beginnings (odd)."""
    words = set(fold_words(text))
    out = {zlib.crc32(w) % BUCKETS & ~1 for w in words}
    for n in BEGINNINGS:
        out.update([zlib.crc32(w, n) % BUCKETS | 1 for w in {w[:n] for w in words if len(w) > n}])
    return out


def labelled(docs: DataFrame, labels: DataFrame, most_broadcast: int, doc_id: str, text: str, lang: str | None) -> DataFrame:
    """(id, fold, toxic, weight, lang, body) of documents with a label; near copies share one document's weight.

    The labels are broadcast only if they are counted to be few; else both sides are shuffled.
    """
    few = labels.count() <= most_broadcast
    bodies = docs.select(col(doc_id).alias("id"), (col(lang) if lang else F.lit(None)).cast("string").alias("lang"), col(text).alias("body"))
    known = labels.where(col("toxic").isNotNull()).groupBy(col(doc_id).alias("id")).agg(F.max("toxic").alias("toxic"))

    def sign(ids: list, texts: list) -> dict:
        signs = []
        for t in texts:
            h = np.fromiter(map(zlib.crc32, set(fold_words(t))), np.uint64)
            other = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            signs.append(int(h.min()) << 31 | int(other.min()) if len(h) else None)
        return {"id": ids, "sign": signs}

    some = bodies.select("id", "body").join(F.broadcast(known) if few else known, "id")
    # stored, so that texts are read once for them and Spark can split the join of a sign that many copies share
    signs = stored(per_batch(some, ["id", "body"], sign, "id long, sign long").where("sign IS NOT NULL"))
    shared = signs.groupBy("sign").agg((1 / F.count(F.lit(1))).alias("weight"))
    weights = signs.join(shared, "sign").groupBy("id").agg(F.min("weight").alias("weight"))
    known = cut_lineage(known.join(weights, "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(2)).cast("int")))
    return bodies.join(F.broadcast(known) if few else known, "id").select("id", "fold", "toxic", "weight", "lang", "body")


def word_counts(rows: DataFrame) -> DataFrame:
    """For each bucket and each half, the weight of the toxic and of the other documents that it occurs in: t0, o0, t1, o1. Each task counts before anything is shuffled."""
    schema = "bucket int, t0 double, o0 double, t1 double, o1 double"
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((4, BUCKETS))
        for batch in batches:
            for part in pieces(batch):
                for fold, toxic, weight, body in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    totals[2 * fold + (not toxic), list(buckets(body))] += weight
        some = np.flatnonzero(totals.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(t[some]) for t in totals)], schema=out)

    # sums of fractions depend on their order in the last digits only; rounded, so that a choice by them is repeatable
    return rows.select("fold", "toxic", "weight", "body").mapInArrow(count, schema).groupBy("bucket").agg(*(F.round(F.sum(c), 6).alias(c) for c in ("t0", "o0", "t1", "o1")))


class ToxicityModel:
    """Weight by bucket, and the ordered cuts."""

    def __init__(self, weights: dict[int, float], cuts: np.ndarray) -> None:
        self.weights, self.cuts = weights, cuts

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        get = self.weights.get
        known = sorted(b for b in buckets(text) if b in self.weights)
        z = sum(get(b, 0.0) for b in known)
        return 1 / (1 + np.exp(-np.clip(z - self.cuts, -50, 50)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, expected: np.ndarray, grade: np.ndarray, weight: np.ndarray, penalty: float = 3e-5, rounds: int = 2000, trust: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts that maximise the likelihood, penalised by the distance from the expected weights; cuts are a start and positive gaps, so they stay in order. Document row[i] has feature column[i].

    trust is the share of the likelihood that is that of the grades; the rest is that of being above grade 0 or not.
    """
    n, d = len(grade), len(expected)
    weight = weight / weight.sum()
    at = np.array([weight[grade >= k].sum() for k in range(1, GRADES + 1)]).clip(1e-4, 1 - 1e-4)
    start = -np.log(at / (1 - at))
    p = np.r_[expected, start[0], np.log(np.maximum(np.diff(start), 0.05))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    # a document lies between the first and the second of these thresholds (0: none below, GRADES + 1: none above)
    parts = [(trust, grade, grade + 1), (1 - trust, np.minimum(grade, 1), np.where(grade > 0, GRADES + 1, 1))]
    for t in range(1, rounds + 1):
        gaps = np.exp(p[d + 1 :])
        cuts = p[d] + np.r_[0, gaps.cumsum()]
        z = np.bincount(row, p[column], n)
        up = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -50, 50))), np.zeros(n)]
        gz, gc = np.zeros(n), np.zeros((n, GRADES + 2))
        for part, above, below in parts:
            hi, lo = up[rows, above], up[rows, below]
            prob = np.maximum(hi - lo, 1e-9)
            dhi, dlo = part * hi * (1 - hi) / prob, part * lo * (1 - lo) / prob
            gz -= dhi - dlo
            gc[rows, above] += dhi
            gc[rows, below] -= dlo
        gcut = weight @ gc[:, 1:-1]
        g = np.r_[np.bincount(column, (weight * gz)[row], d) + penalty * (p[:d] - expected), gcut.sum(), [gcut[k + 1 :].sum() * gaps[k] for k in range(GRADES - 1)]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:d], p[d] + np.r_[0, np.exp(p[d + 1 :]).cumsum()]


def grades_of(marks: np.ndarray, evidence: np.ndarray, langs: list, least: int = 30) -> np.ndarray:
    """0 for what isn't toxic; else 1 to 3 by thirds of the evidence, within a language that has enough toxic documents with any, else over all."""
    some = (marks == 1) & (evidence > 0)
    grade = marks.astype(int)
    names = np.array([x or "" for x in langs])
    groups = [g for g in np.unique(names) if (some & (names == g)).sum() >= least]
    for part in (*(names == g for g in groups), ~np.isin(names, groups)):
        own = some & part
        known = own if own.sum() >= least else some
        if known.any():
            low, high = np.quantile(evidence[known], [1 / 3, 2 / 3])
            grade[own] += (evidence[own] > low).astype(int) + (evidence[own] > high)
    return grade


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, min_toxic: int = 5, min_lift: float = 10.0, min_surprise: float = 15.0, most_broadcast: int = 500_000, doc_id: str = "doc_id", text: str = "text", lang: str | None = None, trust: float = 0.1) -> ToxicityModel:
    """Words and beginnings count as features if they are in min_toxic toxic documents, min_lift times as often as elsewhere, and the likelihood ratio (G2) against equal shares is min_surprise: all of them, at most BUCKETS. The counts cover all labelled documents; the regression is fitted on a hash sample of about fit_rows of them."""
    none = ToxicityModel({}, np.full(GRADES, 50.0))
    rows = labelled(docs, labels, most_broadcast, doc_id, text, lang)
    sizes = {(bool(r[0]), r[1]): r[2] for r in rows.groupBy(F.col("toxic") > 0, "fold").agg(F.sum("weight")).collect()}
    toxic, other = (sum(v for (t, _), v in sizes.items() if t == kind) for kind in (True, False))
    if not toxic or not other:
        return none
    counts = word_counts(rows).withColumns({"toxic": F.col("t0") + F.col("t1"), "other": F.col("o0") + F.col("o1")})
    lift = ((F.col("toxic") + 0.5) / toxic) / ((F.col("other") + 0.5) / other)
    share = toxic / (toxic + other)
    seen = F.col("toxic") + F.col("other")
    surprise = 2 * (F.col("toxic") * F.log(F.col("toxic") / (seen * share)) + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / (seen * (1 - share)))).otherwise(0.0))
    chosen = sorted(counts.where(F.col("toxic") >= min_toxic).withColumn("lift", lift).where((F.col("lift") >= min_lift) & (surprise >= min_surprise)).collect(), key=lambda r: r.bucket)
    if not chosen:
        return none
    place = {r.bucket: i for i, r in enumerate(chosen)}
    # evidence of a word for documents of a half: its log-odds in the other one, if it occurs there in toxic documents
    odds = np.zeros((2, len(chosen)))
    for fold in (0, 1):
        t, o = sizes.get((True, 1 - fold), 0.0), sizes.get((False, 1 - fold), 0.0)
        seen_t, seen_o = (np.array([r[f"{k}{1 - fold}"] for r in chosen]) for k in "to")
        if t and o:
            odds[fold] = np.where(seen_t > 0, np.log((seen_t + 0.5) / t) - np.log((seen_o + 0.5) / o), 0).clip(0)
    odds[:, [r.bucket % 2 == 1 for r in chosen]] = 0  # whole words only
    part = min(1.0, fit_rows / rows.count())
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int(part * (1 << 31)))

    def look(ids: list, folds: list, marks: list, weights: list, langs: list, bodies: list) -> dict:
        used, evidence = [], []
        for f, t in zip(folds, bodies, strict=True):
            found = buckets(t)
            used.append(sorted(place[x] for x in found if x in place))
            evidence.append(float(odds[f, used[-1]].sum()) / max(1.0, float(np.log2(len(found) + 1))))
        return {"id": ids, "toxic": [int(m > 0) for m in marks], "weight": weights, "lang": langs, "used": used, "evidence": evidence}

    got = per_batch(sample, ["id", "fold", "toxic", "weight", "lang", "body"], look, "id long, toxic int, weight double, lang string, used array<int>, evidence double").collect()
    got.sort(key=lambda r: (r.id, r.used, r.evidence))
    marks = np.array([r.toxic for r in got], int)
    if not len(got) or marks.min() == marks.max():
        return none
    row, column = np.repeat(np.arange(len(got)), [len(r.used) for r in got]), np.array([x for r in got for x in r.used], int)
    word = np.array([r.bucket % 2 == 0 for r in chosen])
    grade = grades_of(marks, np.array([r.evidence for r in got]), [r.lang for r in got])
    w, cuts = fit_ordinal(row, column, np.where(word, np.log([r.lift for r in chosen]), 0), grade, np.array([r.weight for r in got]), trust=trust)
    return ToxicityModel({b: float(w[i]) for b, i in place.items()}, cuts)


def score_toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 to 3), grade (the largest with a probability of a half), toxic (grade above 0)."""

    def judge(ids: list, texts: list) -> dict:
        p = [model.at_least(t) for t in texts]
        grade = [int((x >= 0.5).sum()) for x in p]
        return {"doc_id": ids, "expected_severity": [round(float(x.sum()), 6) for x in p], "grade": grade, "toxic": [g > 0 for g in grade]}

    return per_batch(docs, [doc_id, text], judge, "doc_id long, expected_severity double, grade int, toxic boolean")

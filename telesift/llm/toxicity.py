"""Toxicity grades by cumulative-link ordinal regression."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, slices

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5)


def features(text: str | None) -> set[str]:
    """The distinct lower-case words of a text, and the beginnings of its longer words (marked by a hyphen)."""
    found = set(WORD.findall((text or "").lower()))
    return found | {w[:n] + "-" for n in STEMS for w in found if len(w) > n}


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(sum of weights - thresholds[k]); one weight per feature serves every threshold."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) by row and threshold."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def fit_cumulative(indices: np.ndarray, row: np.ndarray, grade: np.ndarray, n_features: int, grades: int, rounds: int = 400, rate: float = 0.08, l2: float = 1e-3, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood.

    indices, row: feature and row of each entry of a binary sparse matrix; weight: of each row.  The thresholds are a first value and
    positive gaps, so they stay in order.  The gradient steps are Adam's.
    """
    n, k = len(grade), grades - 1
    weight = np.ones(n) if weight is None else weight
    share = np.clip([weight[grade > t].sum() / weight.sum() for t in range(k)], 1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    gaps = np.maximum(np.diff(start), 0.05)
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.expm1(gaps))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, first, raw = p[:n_features], p[n_features], p[n_features + 1 :]
        theta = first + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(raw)))])
        score = np.bincount(row, weights=w[indices], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -40, 40)))
        s = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        take = np.arange(n)
        prob = np.maximum(s[take, grade] - s[take, grade + 1], 1e-12)
        slope = s * (1 - s)
        gain = weight / prob
        d_score = (slope[take, grade] - slope[take, grade + 1]) * gain
        d_theta = np.zeros(k + 2)
        np.add.at(d_theta, grade, -slope[take, grade] * gain)
        np.add.at(d_theta, grade + 1, slope[take, grade + 1] * gain)
        d_theta = d_theta[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        g = np.concatenate([np.bincount(indices, weights=d_score[row], minlength=n_features), tail[:1], tail[1:] / (1 + np.exp(-raw))])
        g = -g / weight.sum()
        g[:n_features] += l2 * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    theta = p[n_features] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(p[n_features + 1 :])))])
    return p[:n_features], theta


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = 16_000, vocabulary: int = 4096, least: float = 6.63, split: bool = False) -> OrdinalModel | None:
    """Fit on at most `sample` labelled rows (those with the smallest hash of doc_id) and `vocabulary` features.

    Both numbers bound what reaches the driver.  Features are those that differ most between grade 0 and higher
    grades by the log-likelihood ratio, more than `least` (6.63 is a chance of 0.01 for each); words that tell nothing
    get no weight, so long texts do not drift.  With
    split, a 0/1 grade becomes 0, 1, 2: a first fit scores the labelled rows, and of grade 1 those that score above the
    median are the severe ones.  Rows with a null label or doc_id are not used.  None if there are not two grades.
    """
    chosen = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(grade).cast("int")).alias("_grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def telling(batches):
        for whole in batches:
            # features of a few texts at a time: their names are many times as large
            for lo, hi in slices(whole["text"].str.len().fillna(0).to_numpy(), 1 << 19):
                b = whole.iloc[lo:hi]
                yield pd.DataFrame({"feature": [list(features(t)) for t in b["text"]], "_grade": b["_grade"], "doc_id": b["doc_id"]})

    found = rows.mapInPandas(telling, "feature array<string>, _grade int, doc_id long").select(F.explode("feature").alias("feature"), "_grade")
    per_grade = {r["_grade"]: r["n"] for r in rows.groupBy("_grade").agg(F.count("*").alias("n")).collect()}
    if len(per_grade) < 2:
        return None
    n0 = float(per_grade.get(0, 0))
    n1 = float(sum(n for g, n in per_grade.items() if g != 0))
    counts = found.groupBy("feature").agg(F.sum((F.col("_grade") == 0).cast("double")).alias("a"), F.sum((F.col("_grade") != 0).cast("double")).alias("b"))

    def part(k, n):
        k, share = F.col(k), (F.col("a") + F.col("b")) / (n0 + n1)
        inside = F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
        outside = F.when(k < n, (n - k) * F.log((n - k) / F.greatest(n * (1 - share), F.lit(1e-9)))).otherwise(0.0)
        return inside + outside

    top = counts.where(F.col("a") + F.col("b") >= 2).withColumn("llr", 2 * (part("a", n0) + part("b", n1))).where(F.col("llr") > least).orderBy(F.desc("llr"), "feature").limit(vocabulary).collect()
    names = [r["feature"] for r in top]
    if not names:
        return None
    place = {w: i for i, w in enumerate(names)}

    def coded(batches):
        for b in batches:
            hits = [sorted(place[f] for f in features(t) if f in place) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "_grade": b["_grade"], "hits": hits})

    data = rows.mapInPandas(coded, "doc_id long, _grade int, hits array<int>").orderBy("doc_id", "hits").toPandas()
    y = data["_grade"].to_numpy().astype(int)
    indices = np.fromiter(chain.from_iterable(data["hits"]), dtype=np.int64)
    row = np.repeat(np.arange(len(data)), [len(h) for h in data["hits"]])
    # rare grades count for more, by the root of their rarity, so that fewer of them are missed
    rare = np.where(y > 0, np.sqrt(max(n0, 1.0) / n1), 1.0)
    levels, y = np.unique(y, return_inverse=True)
    weights, theta = fit_cumulative(indices, row, y, len(names), len(levels), weight=rare)
    if split and len(levels) == 2:
        strong = np.bincount(row, weights=weights[indices], minlength=len(y))
        y = np.where(y > 0, 1 + (strong > np.median(strong[y > 0])), 0)
        if y.max() > 1:
            weights, theta = fit_cumulative(indices, row, y, len(names), 3, weight=rare)
    return OrdinalModel({w: float(x) for w, x in zip(names, weights, strict=True) if x}, theta)


def score(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """docs with `severity` (expected grade), `grade` (most likely one) and `p_toxic` (that it is above 0).

    One pass with no shuffle; whole texts are read, however long.  A null or empty text has no features, so it gets the
    base rate.  Each row is scored for itself, so repeated rows score alike; of equally likely grades the lower one
    counts.  Without a model all three are 0.  The model holds at most `vocabulary` features.  Columns of docs that have
    one of the new names are replaced.
    """
    schema, new = "severity double, grade int, p_toxic double", ("severity", "grade", "p_toxic")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in new]
    rows = packed(docs, new)
    if model is None:
        return rows.select(*kept, F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"))

    @F.pandas_udf(schema)
    def judged(texts: pd.Series) -> pd.DataFrame:
        weights, cache = model.weights, {}
        scores = np.zeros(len(texts))
        for i, text in enumerate(texts):
            hits: set[str] = set()
            for w in set(WORD.findall((text or "").lower())):
                known = cache.get(w)
                if known is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    known = cache[w] = tuple(f for f in (w, *(w[:n] + "-" for n in STEMS if len(w) > n)) if f in weights)
                if known:
                    hits.update(known)
            scores[i] = sum(weights[f] for f in sorted(hits))
        above = model.above(scores)
        exact = -np.diff(np.hstack([np.ones((len(scores), 1)), above, np.zeros((len(scores), 1))]), axis=1)
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": exact.argmax(axis=1).astype("int32"), "p_toxic": above[:, 0]})

    return rows.select("_row", judged("_row.text").alias("_j")).select(*kept, "_j.severity", "_j.grade", "_j.p_toxic")

"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another.  Each category's logistic model sees words and word beginnings
that differ in frequency between its classes (chi-square of CHI or more in the rows it trains on), and the
log odds of the categories before it.  In training those come from out-of-fold
predictions (FOLDS folds by a hash of the id), so a later model never leans on fits to its own rows.
Training uses a bounded sample of labelled rows (SAMPLE rows, by a hash of the id); all texts are scored.

Edge cases: null and empty texts have no words and get the bias alone; without labelled rows every
probability is 0; a category with one label value keeps its share as constant; a row with a null label is
left out of that category's training; repeated rows are scored each; other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

SAMPLE, FOLDS, ROUNDS, BEGINNINGS, LEAST, CHI = 8000, 3, 80, (4, 5), 3, 20.0
WORD = re.compile(r"[^\W\d_]+")
CATEGORIES = ("low_quality", "toxic")


def terms(text: str | None) -> set[str]:
    """Distinct words of a text, and the beginnings of its longer words, which end in +."""
    if not text:
        return set()
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "+" for w in words for n in BEGINNINGS if len(w) > n}


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse 0/1 rows of term numbers, and dense extra columns."""

    def __init__(self, numbers: list[np.ndarray], extra: np.ndarray, size: int):
        self.flat = np.concatenate([*numbers, np.zeros(0, np.int64)])
        self.owner = np.repeat(np.arange(len(numbers)), [len(s) for s in numbers])
        self.extra, self.n, self.size = extra, len(numbers), size

    def dot(self, w: np.ndarray, v: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.owner, w[self.flat], self.n) + self.extra @ v + bias


def logistic(rows: Rows, y: np.ndarray, use: np.ndarray, l2: float = 1e-3):
    """Gradient descent with a step per weight (Adam), on the rows in `use`."""
    share = float(y[use].mean()) if use.any() else 0.0
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    w, v = np.zeros(rows.size), np.zeros(rows.extra.shape[1])
    if share in (0.0, 1.0):
        return w, v, bias
    inside = use[rows.owner]
    flat, owner = rows.flat[inside], rows.owner[inside]
    seen = np.bincount(flat, minlength=rows.size)
    hits = np.bincount(flat, y[owner], rows.size)
    n = use.sum()
    chi = (hits - seen * share) ** 2 / np.maximum(seen * (1 - seen / n) * share * (1 - share), 1e-9)
    chosen = (seen >= LEAST) & (chi >= CHI)
    flat, owner = flat[chosen[flat]], owner[chosen[flat]]
    first, second = np.zeros(rows.size + len(v)), np.zeros(rows.size + len(v))
    for t in range(1, ROUNDS + 1):
        miss = np.where(use, sigmoid(np.bincount(owner, w[flat], rows.n) + rows.extra @ v + bias) - y, 0.0) / n
        grad = np.concatenate([np.bincount(flat, miss[owner], rows.size) + l2 * w / 10, rows.extra.T @ miss + l2 * v])
        first = 0.9 * first + 0.1 * grad
        second = 0.98 * second + 0.02 * grad * grad
        step = 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.98**t)) + 1e-6)
        w, v, bias = w - step[: rows.size], v - step[rows.size :], bias - 0.5 * miss.sum()
    return np.where(chosen, w, 0.0), v, bias


class Chain:
    """term_weights: term to its weight in each category's model; models: the weights of earlier odds, and bias."""

    def __init__(self, categories):
        self.categories, self.models, self.thresholds, self.term_weights = list(categories), [], [], {}

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each category, a row per text."""
        zero = np.zeros(len(self.models))
        weight = self.term_weights
        sums = np.array([sum([weight[x] for x in terms(t) if x in weight], zero) for t in texts]).reshape(len(texts), len(self.models))
        odds = np.zeros((len(texts), 0))
        for j, (v, bias) in enumerate(self.models):
            odds = np.column_stack([odds, np.clip(sums[:, j] + odds @ v + bias, -8, 8)])
        return sigmoid(odds)


def fit(rows: DataFrame, categories, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """rows: key, text and a 0/1 column per category."""
    chain = Chain(categories)
    n = rows.count()
    if not n:
        return chain
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.where(draw < min(1.0, sample / n)).select(key, text, *[F.col(c).cast("int").alias(c) for c in categories])

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns=[text]).assign(terms=[sorted(terms(t)) for t in pdf[text]])

    found = written(rows.mapInPandas(run, rows.drop(text).withColumn("terms", F.array(F.lit(""))).schema), "toxicity-terms")
    common = found.select(F.explode("terms").alias("t")).groupBy("t").count().where(F.col("count") >= LEAST)
    names = sorted(r["t"] for r in common.select("t").collect())  # terms of at most `sample` rows
    number = {t: i for i, t in enumerate(names)}
    got, lists = [], []
    for r in found.toLocalIterator():
        got.append([r[key], *[r[c] for c in categories]])
        lists.append(np.array([number[t] for t in r["terms"] if t in number], np.int64))
    fold = np.array([zlib.crc32(f"fold{g[0]}".encode()) % FOLDS for g in got])
    odds, weights = np.zeros((len(lists), 0)), []
    for j in range(len(categories)):
        y = np.array([g[1 + j] for g in got], float)  # None becomes nan
        known = ~np.isnan(y)
        y = np.where(known, y, 0.0)
        data = Rows(lists, odds, len(names))
        outside = np.zeros(len(lists))
        for f in range(FOLDS):
            outside = np.where(fold == f, data.dot(*logistic(data, y, (fold != f) & known)), outside)
        w, v, bias = logistic(data, y, known)
        weights.append(w)
        chain.models.append((v, bias))
        chain.thresholds.append(best_threshold(sigmoid(outside[known]), y[known]))
        odds = np.column_stack([odds, np.clip(outside, -8, 8)])
    table_of = np.array(weights).T
    chain.term_weights = {names[i]: table_of[i] for i in np.flatnonzero(np.abs(table_of).sum(axis=1))}
    return chain


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the greatest F1 on out-of-fold predictions."""
    if not len(p):
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(y.sum(), 1))
    i = int(f1.argmax())
    following = p[order[i + 1]] if i + 1 < len(p) else 0.0
    return float((p[order[i]] + following) / 2)


def score(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Adds p_<category> and is_<category> per category; text is dropped."""
    made = [f"{kind}_{c}" for c in chain.categories for kind in ("p", "is")]
    keep = [c for c in df.columns if c != text and c not in made]
    new = [x for c in chain.categories for x in (F.lit(0.0).alias(f"p_{c}"), F.lit(False).alias(f"is_{c}"))]
    schema = df.select(*keep, *new).schema
    shared = df.sparkSession.sparkContext.broadcast(chain)  # its size is bounded: terms of at most SAMPLE rows

    def run(batches):
        model = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                p = model.predict([t if isinstance(t, str) else None for t in part[text]])
                out = part[keep].copy()
                for j, c in enumerate(model.categories):
                    have = bool(model.models)
                    out[f"p_{c}"] = p[:, j] if have else 0.0
                    out[f"is_{c}"] = (p[:, j] >= model.thresholds[j]) if have else False
                yield out

    return df.select(*keep, text).mapInPandas(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("rows")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = labels.count()
    some = labels.where(drawn < min(1.0, SAMPLE / max(n, 1)))  # bounded, so the join can broadcast it
    chain = fit(written(docs.join(F.broadcast(some), "doc_id"), "toxicity"), CATEGORIES)
    found = score(docs, chain)
    return found.select("doc_id", "is_toxic", F.col("p_toxic").alias("score"), "p_low_quality")

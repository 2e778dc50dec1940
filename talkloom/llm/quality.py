"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each whole text gives a row of statistics (lengths, character classes, repetition of words and lines).
FEATURES random cosines of the standardised statistics approximate a Gaussian kernel; each partition of
labelled rows sums its normal equations, these are added up in two steps, and the ridge solution scores
every row.  Pooled adjacent violators over score bins of all labelled rows make the scores probabilities.

Edge cases: null and empty texts have statistics of zero and are scored like others; without labelled
rows every score is 0.5; null labels are no labels; a key that repeats in the labels counts each time;
labels of unknown documents are left out; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, table, written

FEATURES, RIDGE, BINS, SEED, THRESHOLD = 256, 1.0, 2000, 17, 0.3
STATISTICS = ["log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digit", "blank", "newline",
              "sentence_mark", "shout", "pipe", "symbol", "other_mark", "high", "word_variety", "top_word",
              "next_same", "line_variety", "line_words", "words_per_sentence", "marked_words"]
SYMBOLS = b"#$%&*@^~+=<>\\_{}"


def byte_classes() -> np.ndarray:
    table = np.zeros((256, 9), np.int32)
    for b in range(256):
        c = bytes([b])
        kind = (0 if c.isupper() else 1 if c.isdigit() else 3 if c == b"\n" else 2 if c.isspace() else 4 if c in b".?;:," else 5 if c == b"!"
                else 6 if c == b"|" else 7 if c in SYMBOLS else 8 if b < 128 and not c.isalpha() else -1)
        if kind >= 0:
            table[b, kind] = 1
    return table


_CLASSES = byte_classes()


def statistics(text: str | None) -> list[float]:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digit, blank, newline, mark, shout, pipe, symbol, other = (histogram @ _CLASSES / n).tolist()
    words = text.split()
    count = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    names, codes = np.unique(np.array([hash(w) for w in words], np.int64), return_inverse=True) if words else (np.zeros(0), np.zeros(0, int))
    top = np.bincount(codes).max() / count if words else 0.0
    same = float((codes[1:] == codes[:-1]).sum()) / count if words else 0.0
    lines = [x for x in text.split("\n") if x]
    sentences = histogram[46] + histogram[63] + histogram[33]
    marked = sum(1 for w in words if not w.isalnum()) / count
    return [np.log1p(len(data)), np.log1p(len(words)), sizes.mean() if words else 0.0, sizes.std() if words else 0.0, upper, digit, blank, newline,
            mark, shout, pipe, symbol, other, float(histogram[128:].sum()) / n, len(names) / count / max(1.0, np.log1p(count)) * 5,
            top, same, len(set(lines)) / max(len(lines), 1), np.log1p(count / max(len(lines), 1)), np.log1p(count / (sentences + 1)), marked]


def with_statistics(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Adds `out` array<double> to each row; text is dropped."""
    keep = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*keep, F.array(F.lit(0.0)).alias(out)).schema

    def run(batches):
        for pdf in batches:
            texts = pdf[text].tolist()
            yield pdf[keep].assign(**{out: [statistics(t if isinstance(t, str) else None) for t in texts]})

    return df.select(*keep, text).mapInPandas(run, schema)


class Model:
    """Standardisation, cosines, ridge weights, and the calibration's bin edges and values."""

    def __init__(self, mean, spread, weights=None):
        draw = np.random.default_rng(SEED)
        d = len(STATISTICS)
        self.mean, self.spread, self.weights = mean, spread, weights
        self.frequency, self.phase = draw.normal(0, 1 / np.sqrt(d), (d, FEATURES)) * 1.5, draw.uniform(0, 2 * np.pi, FEATURES)
        self.at, self.value = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        wave = np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase)
        return np.concatenate([wave, z / 10, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.at, self.value)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pooled adjacent violators: the non-decreasing fit to value, in the order of at."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(rows: DataFrame, stats: str = "stats", label: str = "label") -> Model:
    """rows: all labelled rows (stats array<double>, label 0 or 1); none is left out."""
    d = len(STATISTICS)
    rows = rows.where(F.col(label).isNotNull()).select(stats, label)
    moments = rows.agg(F.count("*"), *[F.avg(F.col(stats)[i]) for i in range(d)], *[F.stddev_pop(F.col(stats)[i]) for i in range(d)]).first()
    if not moments[0]:
        return Model(np.zeros(d), np.ones(d))
    spread = np.array([x or 0.0 for x in moments[1 + d :]])
    model = Model(np.array(moments[1 : 1 + d]), np.where(spread > 1e-9, spread, 1.0))
    width = FEATURES + d + 1

    def sums(batches):
        gram, right = np.zeros((width, width)), np.zeros(width)
        for pdf in batches:
            f = model.features(np.array(pdf[stats].tolist()).reshape(-1, d))
            gram += f.T @ f
            right += f.T @ pdf[label].to_numpy(float)
        yield pd.DataFrame({"slot": [0], "part": [np.concatenate([gram.ravel(), right]).tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["part"])
        return pd.DataFrame({"slot": [0], "part": [total.tobytes()]})

    parts = rows.mapInPandas(sums, "slot int, part binary")
    parts = parts.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("slot").applyInPandas(add, "slot int, part binary")
    total = sum(np.frombuffer(r["part"]) for r in parts.collect())  # at most 16 rows of one fixed size
    gram, right = total[: width * width].reshape(width, width), total[width * width :]
    model.weights = np.linalg.solve(gram + RIDGE * np.eye(width), right)

    def binned(batches):
        for pdf in batches:
            raw = np.clip(model.raw(np.array(pdf[stats].tolist()).reshape(-1, d)), -0.5, 1.5)
            yield pd.DataFrame({"bin": np.floor(raw * BINS).astype(int), "label": pdf[label].astype(float)})

    bins = rows.mapInPandas(binned, "bin int, label double").groupBy("bin").agg(F.avg("label").alias("v"), F.count("*").alias("w")).sort("bin").collect()
    at = (np.array([r["bin"] for r in bins]) + 0.5) / BINS  # at most 2 * BINS rows
    model.at, model.value = at, isotonic(at, np.array([r["v"] for r in bins]), np.array([float(r["w"]) for r in bins]))
    return model


def scored(df: DataFrame, model: Model, stats: str = "stats", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1) and predicted to each row; stats are dropped."""
    keep = [c for c in df.columns if c not in (stats, "score", "predicted")]
    schema = df.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        for pdf in batches:
            s = np.clip(model.score(np.array(pdf[stats].tolist()).reshape(-1, len(STATISTICS))), 0.0, 1.0)
            yield pdf[keep].assign(score=s, predicted=(s >= threshold).astype("int32"))

    return df.mapInPandas(run, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, learnt from labels of rows not held out."""
    rows = written(with_statistics(docs.select("doc_id", "text")), "quality")
    known = labels.where(bucket_of("doc_id", 5) != 0).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(rows.join(known, "doc_id"))
    return scored(rows, model).withColumn("held_out", bucket_of("doc_id", 5) == 0)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")

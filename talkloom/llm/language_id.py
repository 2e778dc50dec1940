"""Language identification by nearest centroid over TF-IDF letter n-grams.

Training rows are a bounded sample (PER_LANGUAGE rows a language, chosen by a hash of the id).  Each text
becomes a normalised vector of hashed 1- to 3-gram counts over its lower-cased letters (all else is one
blank), weighted by log counts and inverse document frequency; spherical k-means gives CENTROIDS centroids
a language.  A text takes the language of the centroid with the greatest cosine; its score is that cosine.
A text at distance 1 from all centroids (no letter, so no vector) is rejected as `und`; `rejected` tells which
texts lie further off than all but REJECT_SHARE of the training rows.

Edge cases: null, empty and letterless texts give `und` and score 0; with no training rows, all do; ties go
to the first language in order; repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, by_bytes, table

DIM, PER_LANGUAGE, CENTROIDS, REJECT_SHARE = 4096, 600, 4, 0.001
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, a row per text; a zero row for a text without letters."""
    lowered = [" " + t.lower() + " " for t in texts]
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array(list(map(len, lowered)), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    is_letter = letters()[c]
    c = np.where(is_letter, c, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of other characters stands for all of it
    keep[np.cumsum(sizes) - sizes] = True  # and a text's first blank doesn't hang on the text before
    c, owner, is_letter = c[keep], owner[keep], is_letter[keep]
    out = np.zeros(len(texts) * DIM, np.float32)
    base = owner * DIM
    h = np.zeros(len(c), np.uint32)
    for n in (1, 2, 3):
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] if n > 1 else np.zeros(m, np.uint32)) * np.uint32(0x01000193) + (c[n - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
        g = h ^ (h >> np.uint32(15))
        slot = (g * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        ok = (owner[:m] == owner[n - 1 :]) & (is_letter[:m] | is_letter[n - 1 :])
        out += np.bincount((base[:m] + slot)[ok], minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), DIM)


def vectors(texts: list[str], idf: np.ndarray | None) -> np.ndarray:
    x = np.log1p(counts(texts))
    if idf is not None:
        x *= idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    centres = [x.mean(axis=0)]
    near = x @ centres[0]
    for _ in range(1, min(k, len(x))):
        centres.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floor: float):
        self.languages, self.idf, self.centroids, self.owner, self.floor = languages, idf, centroids, owner, floor

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x = vectors(texts, self.idf)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = x @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(x)), best].astype(float), 0.0, 1.0)
        empty = ~x.any(axis=1)
        found = [("und" if e else self.languages[self.owner[b]]) for e, b in zip(empty, best, strict=True)]
        return found, np.where(empty, 0.0, score), empty | (score < self.floor)


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """rows: labelled rows; at most about per_label of each label are used, by a hash of the key."""
    rows = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(key, text, label)
    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if not n:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), 0.0)
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, min(1.0, per_label / c))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col(label)])

    def frequencies(batches):
        for pdf in batches:
            texts = pdf[text].tolist()
            for lo, hi in by_bytes(texts, 1 << 20):
                seen = counts(texts[lo:hi]) > 0
                yield pd.DataFrame({"n": [hi - lo], "df": [seen.sum(axis=0).astype(float).tolist()]})

    total, df = 0, np.zeros(DIM)
    for r in sample.select(text).mapInPandas(frequencies, "n long, df array<double>").toLocalIterator():
        total, df = total + r["n"], df + np.array(r["df"])
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([vectors(pdf[text].tolist()[i : i + 64], idf) for i in range(0, len(pdf), 64)])
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "low": []})
        c = k_means(x, k)
        low = float(np.quantile((x @ c.T).max(axis=1), REJECT_SHARE))
        return pd.DataFrame({"lang": [pdf[label].iloc[0]] * len(c), "c": c.astype(float).tolist(), "low": low})

    made = sample.groupBy(label).applyInPandas(centres, "lang string, c array<double>, low double").collect()
    languages = sorted({r["lang"] for r in made})
    made = sorted(made, key=lambda r: (r["lang"], r["c"]))
    c = np.array([r["c"] for r in made], np.float32).reshape(-1, DIM)
    return Model(languages, idf, c, np.array([languages.index(r["lang"]) for r in made], int), min((r["low"] for r in made), default=0.0))


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred") -> DataFrame:
    """Adds `out`, score and rejected to each row; text itself is dropped."""
    keep = [c for c in df.columns if c not in (text, out, "score", "rejected")]
    schema = df.select(*keep, F.lit("").alias(out), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed: languages x CENTROIDS x DIM floats

    def run(batches):
        for pdf in batches:
            texts = pdf[text].tolist()
            texts = [t if isinstance(t, str) else "" for t in texts]
            for lo, hi in by_bytes(texts, 1 << 19):
                parts = [shared.value.predict(texts[i : min(i + 256, hi)]) for i in range(lo, hi, 256)]
                lang, score, far = (np.concatenate([np.asarray(p[i], dtype=kind) for p in parts]) for i, kind in enumerate((object, float, bool)))
                yield pdf.iloc[lo:hi][keep].assign(**{out: lang, "score": score, "rejected": far})

    return df.select(*keep, text).mapInPandas(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 4) == 2)
    model = fit(docs.where("not held_out"))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")

"""The registered queries: columns, types, whole tables, rows that may not be learnt from, and accuracy on those."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import language_id, nn_descent, quality, queries, toxicity

COLUMNS = {
    "op1_toxicity": "doc_id bigint, is_toxic boolean, score double, p_low_quality double",
    "op2_line_dedup": "doc_id bigint, n_lines bigint, n_removed_lines bigint, n_removed_chunks bigint, kept_sha256 string",
    "op3_fuzzy_fingerprint": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean",
    "op5_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_nn_descent": "query_id bigint, rank int, vec_id bigint, score double",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_url_filters": "page_id bigint, host string, path string, rule string, verdict string, template string, purity double",
}


@pytest.fixture(scope="session")
def results(spark, sf):
    return {}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_whole_tables(spark, sf, documents, name):
    df = queries.QUERIES[name](spark, sf)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    if name == "op10_nn_descent":
        ids = [r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
        assert sorted({r["query_id"] for r in rows}) == sorted(i for i in ids if i % 20 == 0)
        assert all(r["query_id"] != r["vec_id"] for r in rows) and len(rows) == 20 * len({r["query_id"] for r in rows})
        return
    if name == "op12_url_filters":
        assert sorted(r["page_id"] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id").collect())
        assert {r["verdict"] for r in rows} <= {"allow", "block"} and all((r["rule"] is None) or r["verdict"] for r in rows)
        return
    want = sorted(r[0] for r in documents.select("doc_id").collect())
    assert sorted({r["doc_id"] for r in rows}) == want and (name == "op5_best_fit_packing" or len(rows) == len(want))
    if "held_out" in df.columns:
        n, at = (4, 2) if name == "op4_language_id" else (5, 0)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == at) for r in rows)


def changed(spark, sf, tmp_path, modulus, held, column):
    """The tables with other labels (or languages) for the rows held out."""
    out = str(tmp_path)
    hold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if column in df.columns:
            df = df.withColumn(column, F.when(hold, F.lit("xx") if column == "lang" else 1 - F.col(column)).otherwise(F.col(column)).cast(df.schema[column].dataType))
        df.write.parquet(f"{out}/{name}.parquet")
    return out


def test_language_is_not_learnt_from_rows_held_out(spark, sf, tmp_path, documents):
    rows = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in language_id.op4_language_id(spark, sf).collect()}
    other = language_id.op4_language_id(spark, changed(spark, sf, tmp_path, 4, 2, "lang")).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in other} == rows
    known = {r["doc_id"]: r["lang"] for r in documents.collect()}
    held = [d for d, r in rows.items() if r[2] and r[0] != "und"]
    assert len(held) > 20 and sum(rows[d][0] == known[d] for d in held) / len(held) > 0.95


def test_quality_is_not_learnt_from_rows_held_out(spark, sf, tmp_path):
    rows = {r["doc_id"]: (round(r["score"], 9), r["held_out"]) for r in quality.op6_quality(spark, sf).collect()}
    other = quality.op6_quality(spark, changed(spark, sf, tmp_path, 5, 0, "quality")).collect()
    assert {r["doc_id"]: (round(r["score"], 9), r["held_out"]) for r in other} == rows
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    got = {r["doc_id"]: r["predicted"] for r in quality.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    assert len(labels) > 50 and np.mean([got[r["doc_id"]] == r["quality"] for r in labels]) > 0.95


def test_ridge_weights_by_dense_algebra(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality.with_statistics(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).join(labels, "doc_id").repartition(3).cache()
    model = quality.fit(rows)
    got = rows.collect()
    f, y = model.features(np.array([r["stats"] for r in got])), np.array([float(r["label"]) for r in got])
    want = np.linalg.solve(f.T @ f + quality.RIDGE * np.eye(f.shape[1]), f.T @ y)
    assert np.allclose(f @ model.weights, f @ want, atol=1e-6)
    assert (np.diff(model.value) >= 0).all()


def test_nearest_centroid_by_plain_loops(documents):
    model = language_id.fit(documents, per_label=40)
    texts = [r["text"] for r in documents.limit(30).collect()]
    lang, score, _ = model.predict(texts)
    for text, got, s in zip(texts, lang, score, strict=True):
        v = language_id.vectors([text], model.idf)[0]
        cosines = [(float(sum(a * b for a, b in zip(v.tolist(), c.tolist(), strict=True))), model.languages[j]) for c, j in zip(model.centroids, model.owner, strict=True)]
        best = max(c for c, _ in cosines)
        assert abs(best - s) < 1e-4 and got in {name for c, name in cosines if best - c < 1e-4}


def test_chain_by_plain_loops(spark):
    """The second category's model sees the first one's log odds; a null label trains nothing."""
    rng = np.random.default_rng(3)
    words = [f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    rows = []
    for i in range(500):
        bad = i % 4 == 0
        rows.append((i, " ".join([*rng.choice(words, 20), *(["schuft"] if bad else [])]), int(bad) if i % 7 else None, int(bad and i % 8 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, first int, second int")
    chain = toxicity.fit(df, ("first", "second"))
    texts = [r[1] for r in rows[:40]] + [None, ""]
    for text, got in zip(texts, chain.predict(texts), strict=True):
        odds = []
        for j, (v, bias) in enumerate(chain.models):
            z = bias + sum(chain.term_weights[t][j] for t in toxicity.terms(text) if t in chain.term_weights) + sum(a * b for a, b in zip(odds, v, strict=True))
            odds.append(min(max(z, -8.0), 8.0))
        assert np.allclose(got, [1 / (1 + np.exp(-z)) for z in odds])
    found = {r["doc_id"]: r["is_first"] for r in toxicity.score(df, chain).collect()}
    assert all(found[i] == (i % 4 == 0) for i in range(500))
    alone = toxicity.fit(df.where("first is not null"), ("first",))
    assert set(alone.term_weights) == {t for t, w in chain.term_weights.items() if w[0]}


def test_toxic_rows_outside_the_sample(spark, sf):
    """Learnt from a part of the labels, held against the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    chain = toxicity.fit(docs.join(labels.where(part), "doc_id"), toxicity.CATEGORIES)
    rest = toxicity.score(docs.join(labels.where(~part), "doc_id"), chain).collect()
    assert np.mean([r["is_toxic"] == bool(r["toxic"]) for r in rest]) > 0.95


def test_recall_over_several_blocks(spark, monkeypatch):
    """Small blocks, so that most neighbours must be found by the rounds."""
    for name, value in (("BLOCK", 60), ("TREES", 2), ("QUERIES", 16)):
        monkeypatch.setattr(nn_descent, name, value)
    x = np.random.default_rng(14).normal(size=(1500, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (75 * 20) >= 0.9

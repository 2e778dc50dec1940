"""Hard negatives against brute force."""

import duckdb
import numpy as np
import pytest

from talkloom.llm import hard_negatives as hard


def brute(rows, positives=5, negatives=10):
    """rows: (id, label, vector).  Every anchor against every row, in whole numbers."""
    out = []
    for a, own, x in rows:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), b, label) for b, label, y in rows if b != a)
        for s, p, _ in [r for r in scored if r[2] == own][:positives]:
            within = [r for r in scored if r[2] != own and -30 * s <= -100 * r[0] <= -90 * s][:negatives]
            out += [(a, p, i, n, -s, -t) for i, (t, n, _) in enumerate(within, 1)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in hard.hard_negatives(df, "id % 100 = 0", **more).collect())


SCHEMA = "vec_id long, label int, vector array<long>"


@pytest.mark.parametrize("seed, labels, spread, d", [(1, 4, 60, 64), (2, 2, 3, 7), (3, 10, 400, 33), (4, 1, 50, 16), (5, 3, 3 * 10**8, 5)])
def test_by_brute_force(spark, monkeypatch, seed, labels, spread, d):
    """Small chunks and blocks, ties, clusters and very large components."""
    monkeypatch.setattr(hard, "ROWS", 300)
    monkeypatch.setattr(hard, "BLOCK", 64)
    monkeypatch.setattr(hard, "ANCHORS", 3)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, d))
    x = centres[rng.integers(0, 6, 1500)] + rng.normal(0, 0.4, (1500, d))
    x[rng.random(1500) < 0.2] = x[0]
    rows = [(i, int(rng.integers(0, labels)), [int(v) for v in np.floor(spread * x[i])]) for i in range(1500)]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == want and (want or labels == 1)


def test_shuffled_anchors(spark, monkeypatch):
    """Beyond the bound for broadcasts."""
    monkeypatch.setattr(hard, "BROADCAST", -1)
    monkeypatch.setattr(hard, "ANCHORS", 2)
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-9, 30, 20).tolist()) for i in range(900)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, y = (hard.Rows(rng.integers(-500, 500, (40, 64)), np.arange(40), np.arange(40)) for _ in range(2))
    exact, width = x.x @ y.x.T, []
    for level in range(len(hard.SEGMENTS)):
        low, high = hard.bounds(x, y, level)
        assert (low <= exact).all() and (exact <= high).all()
        width.append((high - low).mean())
    assert width == sorted(width, reverse=True)


def test_edge_cases(spark):
    """Null ids, labels, vectors and components go; short and empty vectors, repeated ids, few rows."""
    big = 2**62
    rows = [(0, 1, [4, 4]), (1, 1, [4, 4]), (2, 2, [2, 2]), (3, 2, None), (None, 2, [2, 2]), (5, None, [2, 2]), (6, 2, [2, None]), (7, 2, []), (8, 3, [4]), (2, 2, [2, 2]), (0, 2, [3, 3]), (9, 3, [2, 2, 9])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", score int, row string")
    got = found(df)
    assert [r for r in got if r[:2] == (0, 1)] == [(0, 1, 1, 2, 32, 16), (0, 1, 2, 2, 32, 16), (0, 1, 3, 8, 32, 16), (0, 1, 4, 9, 32, 16)]
    assert all(None not in r for r in got)
    assert found(spark.createDataFrame([], SCHEMA)) == [] and found(spark.createDataFrame([(1, 1, [1])], SCHEMA)) == []
    assert found(spark.createDataFrame([(0, 1, [big] * 9), (1, 1, [big] * 9), (2, 2, [1, 1])], SCHEMA)) == []


def test_query_by_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(hard.OP13_SQL).fetchall())
    got = hard.op13_hard_negatives(spark, sf)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100

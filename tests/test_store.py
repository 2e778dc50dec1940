"""The bucketed store, and streams into it."""

import json
import os

import pytest
from pyspark.sql import functions as F

from talkloom.sources import sessions as src
from talkloom.sources import store


def record(i, at=None):
    return {"id": f"s{i}", "createdAt": i if at is None else at, "audioFileName": " ", "metadata": {"title": f"T{i}"}, "participants": {"0": "Ann"},
            "transcript": {"totalDurationMs": 900, "segments": [{"speakerId": 0, "startMs": 0, "endMs": 900, "words": [{"text": "a", "startMs": 0, "endMs": 9, "confidence": 0.9}]}]}}


def data_files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def kept(spark, path, upto=None):
    return {r["id"]: r["v"] for r in store.current(spark, path, upto).collect()}


def test_upsert_delete_and_compaction(spark, tmp_path):
    """A thousand records in sets of ten, some replaced, some deleted, some put again; at last one file a bucket."""
    path, want = str(tmp_path / "store"), {}
    rows = lambda pairs: spark.createDataFrame(pairs, "id string, v int").withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    for n in range(6):
        new = [(f"r{i}", i + 10_000 * n) for i in range(1000) if n == 0 or i % 7 == n]
        store.put(rows(new), path, n)
        want |= dict(new)
    store.delete(rows([(f"r{i}", 0) for i in range(0, 1000, 3)]), rows([("x", 0)]), path, 6)
    want = {k: v for k, v in want.items() if int(k[1:]) % 3}
    store.put(rows([("r3", 5), ("new", 1), ("new", 1)]), path, 7)
    want |= {"r3": 5, "new": 1}
    assert kept(spark, path) == want and kept(spark, path, 0) == {f"r{i}": i for i in range(1000)}
    assert len(data_files(path)) > 100
    store.compact(spark, path, 6)  # a later set stays beside it
    assert kept(spark, path) == want and {n for n, _ in store.sequences(path)} == {6, 7}
    store.compact(spark, path, 7)
    store.compact(spark, path, 7)
    assert kept(spark, path) == want and len(data_files(path)) == 16
    assert spark.read.parquet(path).where("gone").count() == 0  # nothing older is left that a deletion hides


def test_a_broken_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(f"r{i}", i) for i in range(50)], "id string, v int")
    store.put(rows, path, 0)
    store.delete(rows.where("v < 10"), rows, path, 1)
    want = kept(spark, path)

    class Stuck:
        def delete_dir(self, folder):
            raise OSError(folder)

    opened = store.opened
    calls = []
    monkeypatch.setattr(store, "opened", lambda p: (calls.append(p), opened(p) if len(calls) == 1 else (Stuck(), p))[1])
    with pytest.raises(OSError):
        store.compact(spark, path, 1)  # written, but the earlier folders stay
    monkeypatch.setattr(store, "opened", opened)
    assert kept(spark, path) == want and len(want) == 40
    store.compact(spark, path, 1)
    assert kept(spark, path) == want


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    into, path, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    os.mkdir(into)
    for n, ids in enumerate([range(4), range(2, 7), [3]]):
        for i in ids:
            with open(f"{into}/session_{n}_{i}.json", "w") as f:
                f.write(json.dumps(record(i, 100 * n + i), indent=1))
        with open(f"{into}/session_bad{n}.json", "w") as f:
            f.write("{cut")
        store.stream_into(src.session_stream(spark, into), path, checkpoint)
    want = {"s0": 0, "s1": 1, "s2": 102, "s3": 203, "s4": 104, "s5": 105, "s6": 106}
    now = lambda: {r["id"]: r["createdAt"] for r in store.current(spark, path).collect()}
    assert now() == want
    commits = [f for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()]
    last = max(commits, key=int)
    for name in (last, f".{last}.crc"):  # the last batch was written, but its commit was lost
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    store.stream_into(src.session_stream(spark, into), path, checkpoint)
    assert now() == want and spark.read.parquet(path).where("key = 's3'").count() == 3
    batch = src.read_sessions(spark, into)
    assert {r["id"] for r in batch.select("id").collect()} == set(want)

"""Scans over range partitions against windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from talkloom.operators import intervals, scan, transcript


@pytest.fixture(scope="module")
def rows(spark):
    """A key that holds most rows, small ones, a null key, and ties in the order."""
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(700), i, rng.randrange(-5, 50)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, t int, i int, v int").cache()


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans_equal_windows(spark, rows, parts):
    order = ["t", "i"]
    laid = scan.laid_out(rows, ["k"], order, parts)
    w = Window.partitionBy("k").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    cases = [(scan.running_sum(laid, ["k"], order, F.col("v"), "x"), F.coalesce(F.sum("v").over(upto), F.lit(0))),
             (scan.running_sum(laid, ["k"], order, F.col("v"), "x", own=False), F.coalesce(F.sum("v").over(before), F.lit(0))),
             (scan.running_max(laid, ["k"], order, F.col("v"), "x", own=False), F.max("v").over(before)),
             (scan.previous(laid, ["k"], order, ["v", "i"]).withColumn("x", F.col("_before.i")), F.lag("i").over(w))]
    for got, want in cases:
        assert {(r["i"], r["x"]) for r in got.collect()} == {(r["i"], r["x"]) for r in rows.withColumn("x", want).collect()}
    if parts == 40:
        assert laid.where("k = 'hot'").select(scan.PART).distinct().count() > 10  # one key, many tasks


def test_merges_equal_windows(spark, rows):
    e = rows.select("k", (F.col("t") + F.col("i") / 3000).alias("start_s")).withColumn("end_s", F.col("start_s") + 0.4)
    plain = intervals.merged_intervals(e, ["k"], pause=0.3, least=0.1)
    assert sorted(map(str, intervals.merged_intervals(e, ["k"], pause=0.3, least=0.1, parts=16).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    s = rows.select(F.col("k").alias("session_id"), F.col("i").alias("seg_idx"), (F.col("v") % 2).alias("speaker_id"), (F.col("i") * 1000).alias("start_ms"), (F.col("i") * 1000 + F.col("v") * 40).alias("end_ms"), F.lit("x").alias("text"))
    plain = transcript.merged_turns(s)
    assert sorted(map(str, transcript.merged_turns(s, parts=16).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    chunks = s.withColumn("chunk_idx", F.expr("seg_idx div 10")).where("session_id is not null")
    starts = chunks.select("session_id", "chunk_idx").distinct().withColumn("chunk_start_ms", F.col("chunk_idx") * 7)
    plain = transcript.stitched_chunks(chunks, starts)
    assert sorted(map(str, transcript.stitched_chunks(chunks, starts, parts=16).select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert intervals.merged_intervals(e.limit(0), ["k"], parts=4).count() == 0

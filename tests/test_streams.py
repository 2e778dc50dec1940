from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from talkloom.operators import intervals
from talkloom.streaming import streams


def source(spark, tmp_path, rows):
    """Two files, read one a batch."""
    df = spark.createDataFrame(rows, "key string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        df.where(f"(unix_seconds(ts) < 1704067230) = {i == 0}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return df, stream


def drained(df, spark, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


ROWS = [("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in range(0, 60, 3)] + [("b", f"2024-01-01 00:00:{s:02d}", 1.0) for s in (0, 1, 2, 40, 41)]


def test_level_meter_equals_batch(spark, tmp_path):
    df, stream = source(spark, tmp_path, ROWS)
    got = drained(streams.level_meter(stream, "key", "10 seconds", "1 hour", clip=False), spark, "level", tmp_path, "complete")
    want = intervals.rms_level(df, "key", "10 seconds", clip=False)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_runs(spark, tmp_path):
    _, stream = source(spark, tmp_path, ROWS)
    got = drained(streams.activity_runs(stream, "key", "10 seconds", "1 hour"), spark, "runs", tmp_path, "complete")
    assert sorted((r["key"], r["n"]) for r in got.collect()) == [("a", 20), ("b", 2), ("b", 3)]


def test_resampling_carries_state(spark, tmp_path):
    df, stream = source(spark, tmp_path, ROWS)
    got = {(r["key"], r["ts"]): round(r["value"], 6) for r in drained(streams.resampled_stream(stream, "key", 2), spark, "resampled", tmp_path).collect()}
    want = {(r["key"], r["ts"]): round(r["value"], 6) for r in intervals.resampled(df, "key", "2 seconds").collect()}
    last = df.groupBy("key").agg(F.max("ts").alias("t")).collect()
    ends = {r["key"]: r["t"] for r in last}
    assert got == {k: v for k, v in want.items() if k[1] < ends[k[0]]}


def test_resampling_drops_state_and_late_rows(spark, tmp_path):
    """Series that end are closed as in a batch, their state goes, and rows behind the watermark are left out."""
    day = "2024-01-01 00:"
    parts = [[("a", f"{day}00:{s:02d}", float(s)) for s in (0, 3, 7)] + [("b", f"{day}00:05", 1.0)], [("c", f"{day}10:00", 5.0), ("b", f"{day}10:01", 2.0)],
             [("a", f"{day}00:09", 99.0), ("c", f"{day}10:03", 8.0)], [("end", f"{day}59:00", 0.0)]]
    schema = "key string, ts timestamp, value double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = streams.resampled_stream(stream, "key", 2, late="0 seconds", gap_seconds=60)
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "key string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress["stateOperators"] else None
    rows = [r for p in parts for r in p if r != ("a", f"{day}00:09", 99.0)]  # late: the watermark is at 10:01
    series = spark.createDataFrame([(f"{k}{int(t[14:16])}", t, v) for k, t, v in rows if k != "end"], "key string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {(r["key"][0], r["ts"], round(r["value"], 6)) for r in intervals.resampled(series, "key", "2 seconds").collect()}
    got = {(r["key"], r["ts"], round(r["value"], 6)) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()}
    assert {g for g in got if g[0] != "end"} == want
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "c"))
    assert [r["key"][0] for r in left.collect()] == ["end"] and state is not None


class Counted:
    """State and timers of one key, with the number of calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def __getattr__(self, name):
        def call(x=None):
            self.calls += 1
            if name == "get":
                return self.value
            if name in ("update", "clear"):
                self.value = x
            else:
                {"registerTimer": self.timers.append, "deleteTimer": self.timers.remove}[name](x)
        return call


def test_resampling_calls_a_batch():
    """A batch reads a key's state and writes it; its one timer is set again when it goes off before the series ends."""
    key, r = Counted(), streams.Resampler(2_000_000, 60_000_000)
    r.init(key)
    at, got = lambda s: SimpleNamespace(getCurrentWatermarkInMs=lambda: s * 1000), []
    for i, seconds in enumerate(([0, 1, 5], [7], [8, 12])):
        key.calls = 0
        got += r.handleInputRows(("a",), iter([Row(t=s * 1_000_000, v=None if s == 1 else float(s)) for s in seconds]), at(0))
        assert key.calls <= (3 if i == 0 else 2)
    assert key.timers == [65_000]
    for due in (66, 72):  # 60 s after the sample at 5, and after that at 12
        key.timers.clear()
        end = list(r.handleExpiredTimer(("a",), at(due), None))
        assert (end, key.timers) == ([], [72_000]) if due == 66 else (key.value is None and not key.timers)
    assert [(p["t"] // 1_000_000, p["value"]) for p in got + end if p["value"] == p["value"]] == [(0, 0.0), (6, 6.0), (8, 8.0), (10, 10.0), (12, 12.0)]

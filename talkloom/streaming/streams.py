"""Streaming forms: level meter, resampling with carried state, and runs between pauses."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.intervals import rms_level


def level_meter(samples: DataFrame, key: str, width: str, late: str, ts: str = "ts", value: str = "value", clip: bool = True) -> DataFrame:
    """rms_level over a stream; samples later than `late` are left out."""
    return rms_level(samples.withWatermark(ts, late), key, width, ts, value, clip)


def activity_runs(events: DataFrame, key: str, gap: str, late: str, ts: str = "ts") -> DataFrame:
    """key, start, end (of the last event), n: runs without a pause of `gap` or more."""
    runs = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w"))
    return runs.agg(F.count("*").alias("n"), F.max(ts).alias("end")).select(key, F.col("w.start").alias("start"), "end", "n")


LAST = T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("next", T.LongType())])


POINT = Row("key", "t", "value")


class Resampler(StatefulProcessor):
    """Linear resampling of each key's samples to a grid; the last sample and the next grid point are carried
    from batch to batch.  Samples at or before the last one carried, or before the watermark, are late and left out.
    Once the watermark is `gap` behind a key's last sample, that sample is held to the end of its step and the key's
    state goes; samples that come after start a new grid.

    A key has one timer as long as it has state: where later samples came, it is set again when it goes off, so that a
    batch costs a key two calls, one to read its state and one to write it."""

    def __init__(self, step_us: int, gap_us: int):
        self.step, self.gap = step_us, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", LAST)

    def expiry(self, t: int) -> int:
        return -(-(t + self.gap) // 1000)

    def end(self, t: int, grid: int) -> list[int]:
        """The grid point at which the last sample is held; a first sample alone is its own and has been given."""
        return [grid] if grid - self.step != t else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        mark, held = timerValues.getCurrentWatermarkInMs() * 1000, {}
        for r in rows:
            if r["t"] is not None and r["t"] >= mark:
                held.setdefault(r["t"], []).append(r["v"])
        t0, v0, grid = self.last.get() or (None, None, None)
        before = t0
        for t in sorted(held):
            if t0 is not None and t <= t0:
                continue
            known = [x for x in held[t] if x is not None and x == x]
            v = sum(known) / len(known) if known else float("nan")
            if t0 is not None and t - t0 > self.gap:  # the series ended within this batch
                for at in self.end(t0, grid):
                    yield POINT(key[0], at, v0)
                t0 = None
            if t0 is None:
                grid = t
            while grid <= t if t0 is None else grid < t:
                yield POINT(key[0], grid, v if t0 is None or t == t0 else v0 + (v - v0) * (grid - t0) / (t - t0))
                grid += self.step
            t0, v0 = t, v
        if t0 is not None and t0 != before:
            self.last.update((t0, v0, grid))
            if before is None:
                self.handle.registerTimer(self.expiry(t0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        t, v, grid = self.last.get()
        if self.expiry(t) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self.expiry(t))
            return
        self.last.clear()
        for at in self.end(t, grid):
            yield POINT(key[0], at, v)

    def close(self) -> None:
        pass


def resampled_stream(samples: DataFrame, key: str, step_seconds: int, ts: str = "ts", value: str = "value", late: str = "0 seconds", gap_seconds: int = 1 << 31) -> DataFrame:
    """key, ts, value as intervals.resampled gives them; the end of a series is given, and its state dropped, once the
    watermark (`late` behind the latest sample) is gap_seconds past its last sample.  Needs the RocksDB state store."""
    rows = samples.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts), F.unix_micros(ts).alias("t"), F.col(value).cast("double").alias("v"))
    kind = dict(samples.dtypes)[key]
    out = rows.groupBy("key").transformWithState(Resampler(step_seconds * 1_000_000, gap_seconds * 1_000_000), f"key {kind}, t bigint, value double", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("t").alias("ts"), "value")

"""Intervals and time series: chunks, merging by pause, resampling, mixing, levels and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

HALF_HOUR_MS = 1_800_000


def too_long(recordings: DataFrame, most_ms: int = HALF_HOUR_MS) -> DataFrame:
    return recordings.where(F.col("duration_ms") > most_ms)


def fixed_chunks(recordings: DataFrame, keys: list[str], length_ms: int = HALF_HOUR_MS) -> DataFrame:
    """keys, chunk_idx, start_ms, end_ms; the last chunk ends with the recording."""
    last = F.ceil(F.col("duration_ms") / length_ms).cast("long") - 1
    rows = recordings.where("duration_ms > 0").select(*keys, "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx"))
    start = F.col("chunk_idx") * length_ms
    return rows.select(*keys, "chunk_idx", start.alias("start_ms"), F.least(start + length_ms, F.col("duration_ms")).alias("end_ms"))


def overlapping_chunks(recordings: DataFrame, keys: list[str], length_ms: int = 45_000, overlap_ms: int = 500) -> DataFrame:
    """Chunks that start every length - overlap and stop with the first that reaches the end."""
    step = length_ms - overlap_ms
    last = F.greatest(F.ceil((F.col("duration_ms") - length_ms) / step), F.lit(0)).cast("long")
    rows = recordings.where("duration_ms > 0").select(*keys, "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx"))
    start = F.col("chunk_idx") * step
    return rows.select(*keys, "chunk_idx", start.alias("start_ms"), F.least(start + length_ms, F.col("duration_ms")).alias("end_ms"))


def merged_intervals(df: DataFrame, keys: list[str], start: str = "start_s", end: str = "end_s", pause: float = 0.5, least: float = 0.3, parts: int | None = None) -> DataFrame:
    """keys, run, start, end, n: intervals with a pause under `pause` are one; shorter ones than `least` go.  parts: spread
    each key over so many ranges, for keys too large for one task."""
    order = [start, end]
    fresh = lambda reach: F.when(F.col(start) - reach < pause, 0).otherwise(1)
    if parts:
        reached = scan.running_max(scan.laid_out(df, keys, order, parts), keys, order, F.col(end), "_reach", own=False)
        runs = scan.running_sum(reached.withColumn("_new", fresh(F.col("_reach"))), keys, order, F.col("_new"), "run").withColumn("run", F.col("run") - 1)
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = df.withColumn("_new", fresh(reach)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = runs.groupBy(*keys, "run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))
    return out.where(F.col(end) - F.col(start) >= least)


def resampled(samples: DataFrame, key: str, step: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """key, ts, value on a grid of `step` (a whole number of seconds as text) from the first sample on, linear
    in between; the last sample is held to the end of its step."""
    seconds = int(step.split()[0])
    at = samples.select(key, F.unix_micros(F.col(ts)).alias("t"), F.col(value).cast("double").alias("v"))
    w = Window.partitionBy(key).orderBy("t")
    at = at.groupBy(key, "t").agg(F.avg("v").alias("v"))
    at = at.select(key, "t", "v", F.lead("t").over(w).alias("t2"), F.lead("v").over(w).alias("v2"), F.min("t").over(Window.partitionBy(key)).alias("t0"))
    unit = F.lit(seconds * 1_000_000)
    first = F.ceil((F.col("t") - F.col("t0")) / unit).cast("long")
    last = F.when(F.col("t2").isNull(), first).otherwise(F.ceil((F.col("t2") - F.col("t0")) / unit).cast("long") - 1)
    grid = at.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("g"))
    g = F.col("t0") + F.col("g") * unit
    share = (g - F.col("t")) / (F.col("t2") - F.col("t"))
    return grid.select(key, F.timestamp_micros(g).alias("ts"), F.coalesce(F.col("v") + (F.col("v2") - F.col("v")) * share, F.col("v")).alias("value"))


def downmixed(frames: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Integer mean over the channels of a frame, truncated and held within 16 bit."""
    mean = F.expr(f"sum({value}) div count({value})")
    return frames.groupBy(*keys).agg(F.greatest(F.least(mean, F.lit(32767)), F.lit(-32768)).cast("int").alias("value"))


def rms(value: Column) -> Column:
    return F.least(F.sqrt(F.avg(value * value)), F.lit(1.0))


def rms_level(samples: DataFrame, key: str, width: str, ts: str = "ts", value: str = "value", clip: bool = True) -> DataFrame:
    """key, start, level over tumbling windows; level is held within 1 if clip."""
    level = F.sqrt(F.avg(F.col(value) * F.col(value)))
    out = samples.groupBy(key, F.window(ts, width).alias("_w")).agg((F.least(level, F.lit(1.0)) if clip else level).alias("level"))
    return out.select(key, F.col("_w.start").alias("start"), "level")


def samples_to_ms(samples: Column, rate: Column) -> Column:
    return F.floor(samples * 1000 / rate).cast("long")


def bytes_to_ms(size: Column, rate: Column, channels: Column) -> Column:
    return F.floor(size * 1000 / (rate * channels * 2)).cast("long")


def pcm16(value: Column) -> Column:
    return value / 32768.0

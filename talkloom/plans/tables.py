"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as segments: 400 ms a word, a gap of (turn % 3) * 1500 ms before a turn."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations")
    n = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    rows = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seg_idx"), F.expr("(turn div 2) % 2").cast("int").alias("speaker_id"), "role", "text", (n * 400).cast("long").alias("_d"), (F.col("turn") % 3 * 1500).cast("long").alias("_gap"))
    w = Window.partitionBy("session_id").orderBy("seg_idx")
    end = F.sum(F.col("_d") + F.col("_gap")).over(w)
    return rows.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - F.col("_d")).drop("_d", "_gap")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's even speaker takes the name of its first role; the other has none."""
    c = read(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("session_id")).agg(F.min_by("role", "turn").alias("name")).withColumn("speaker_id", F.lit(0))

"""Files against a manifest: validity, what is pending, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds status to each manifest row: missing, size, hash or valid, whichever comes first.  A hash that
    starts with PLACEHOLDER is not checked.  Of files with one name the longest counts."""
    found = inventory.groupBy("filename").agg(F.max(F.struct("length", "sha256")).alias("_f"))
    files = found.select("filename", F.col("_f.length").alias("_length"), F.col("_f.sha256").alias("_sha"))
    both = manifest.join(files, "filename", "left")
    status = (F.when(F.col("_length").isNull(), "missing").when(F.col("_length") != F.col("size_bytes"), "size")
              .when(~F.col("sha256").startswith("PLACEHOLDER") & (F.lower("sha256") != F.lower("_sha")), "hash").otherwise("valid"))
    return both.withColumn("status", status).drop("_length", "_sha")


def pending(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    valid = checked(manifest, inventory).where("status = 'valid'").select("id")
    return manifest.join(valid, "id", "left_anti")


def totals(checked_manifest: DataFrame, by: str = "tier") -> DataFrame:
    return checked_manifest.groupBy(by).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"), F.bool_and(F.col("status") == "valid").alias("all_valid"))

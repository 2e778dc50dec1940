"""Running values over a key of any size: a prefix scan in two passes over range partitions.

A window holds a key's rows in one task.  Here rows are laid out in ranges of (key, order), so a large key lies in
many parts.  Within a part a value runs by a window of the part; each part's summary (a sum, a largest value, its last
row) is carried to the parts behind it.  A part has at most one key that began in an earlier one, so no more
carries than parts are joined back, which is why they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

PART = "_part"


def laid_out(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """df with its part.  Stored, so that every later pass sees the same ranges; rows equal in keys and order share a part."""
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()), "scan-rows")


def _joined(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    there = carry.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(PART).alias("_p"), "_carry")
    same = F.col(PART) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(there), same, "left").drop("_p", *(f"_k{i}" for i in range(len(keys))))


def _running(rows: DataFrame, keys: list[str], order: list[str], out: str, value: Column, own: bool, total, both) -> DataFrame:
    within = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, PART).agg(total(value).alias("_v")).select(*keys, PART, total(F.col("_v")).over(before).alias("_carry")).where("_carry is not null")
    here = _joined(rows.withColumn("_here", total(value).over(within)), carry, keys)
    return here.withColumn(out, both(F.col("_here"), F.col("_carry"))).drop("_here", "_carry")


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, own: bool = True) -> DataFrame:
    """rows (laid out) with the sum of value over the key's rows up to this one; own=False leaves its own value out."""
    return _running(rows, keys, order, out, value, own, F.sum, lambda a, c: F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0)))


def running_max(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str, own: bool = True) -> DataFrame:
    """The same with the largest value; null where there is none."""
    return _running(rows, keys, order, out, value, own, F.max, lambda a, c: F.greatest(a, c))


def previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """rows with _before, a struct of the columns of the key's row before; null at its first row."""
    within = Window.partitionBy(*keys, PART).orderBy(*order)
    row = F.struct(*columns)
    last = rows.groupBy(*keys, PART).agg(F.max_by(row, F.struct(*order)).alias("_v"))
    carry = last.select(*keys, PART, F.lag("_v").over(Window.partitionBy(*keys).orderBy(PART)).alias("_carry")).where("_carry is not null")
    here = _joined(rows.select("*", F.lag(row).over(within).alias("_here"), F.row_number().over(within).alias("_i")), carry, keys)
    return here.withColumn("_before", F.when(F.col("_i") > 1, F.col("_here")).otherwise(F.col("_carry"))).drop("_here", "_carry", "_i")

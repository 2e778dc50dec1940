"""Joins of times by overlap: an equi-join on cells whose width follows each row's own length.

A row of length d belongs to the lowest level, of those STEP apart, whose cells are 2^level >= d wide, so it touches at
most two cells of its level.
Of two rows that overlap, the shorter one (by level) is sent to the cells of the longer one's level.  So a row is copied
at most twice for each level that occurs on the other side, however long it is, and a key that holds most rows is
spread over its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 10  #: cells are 2^LEAST wide or wider
STEP = 3  #: levels apart: a cell is up to 2^STEP times as wide as its rows are long, and a row is copied for fewer levels


def _level(start: str, end: str, least: int) -> Column:
    above = F.greatest(F.length(F.bin(F.col(end) - F.col(start) - 1)) - least, F.lit(0))
    return F.least(F.ceil(above / STEP) * STEP + least, F.lit(63)).cast("int")  # no shift goes further


def _cells(start: Column, end: Column, level: Column) -> Column:
    return F.sequence(F.call_function("shiftright", start, level), F.call_function("shiftright", end - 1, level))


def _levels(rows: DataFrame) -> list[int]:
    """The levels that occur: 64 / STEP at most."""
    return sorted(r[0] for r in rows.select("_level").distinct().collect())


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", least: int = LEAST) -> DataFrame:
    """Each pair of rows of the same keys whose times [start, end), whole numbers, have a part in common: left's
    columns, `other` (right's columns as a struct) and overlap.  Rows with a null key or time, or that do not end after
    they start, are in no pair.  Both sides are read twice: their levels are looked up while the plan is made."""
    sides = []
    for df in (left, right):
        row = df.where(F.col(end) > F.col(start)).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"), F.struct(*df.columns).alias("_row"))
        sides.append(row.withColumn("_level", _level("_a", "_b", least)))
    used = [_levels(x) for x in sides]

    def at(rows: DataFrame, own: int, others: list[int]) -> DataFrame:
        """way 0 holds pairs whose right row is at the cells' level, way 1 those whose left row alone is."""
        cell = lambda way, level: F.transform(_cells(F.col("_a"), F.col("_b"), level), lambda c: F.struct(F.lit(way).alias("way"), level.alias("level"), c.alias("cell")))
        above = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x >= F.col("_level") if own else x > F.col("_level"))
        sent = F.flatten(F.transform(above, lambda x: cell(1 - own, x)))
        return rows.withColumn("_at", F.explode(F.concat(cell(own, F.col("_level")), sent))).select("*", "_at.way", "_at.level", "_at.cell").drop("_at", "_level")

    a = at(sides[0], 1, used[1])
    b = at(sides[1], 0, used[0]).withColumnsRenamed({"_a": "_c", "_b": "_d", "_row": "other"})
    on = [*(f"_k{i}" for i in range(len(keys))), "way", "level", "cell"]
    first = F.greatest(F.call_function("shiftright", F.col("_a"), F.col("level")), F.call_function("shiftright", F.col("_c"), F.col("level")))
    shared = F.least("_b", "_d") - F.greatest("_a", "_c")
    return a.join(b, on).where((shared > 0) & (F.col("cell") == first)).select("_row.*", "other", shared.alias("overlap"))


def speakers_by_time(words: DataFrame, intervals: DataFrame, keys: list[str], word_keys: list[str], speaker: str = "speaker_id", default: int = 0, least: int = LEAST) -> DataFrame:
    """words with the speaker whose intervals cover most of the word's time; of equal ones the smallest id.  A word
    that none covers gets the default, as a recording without intervals does.  keys and word_keys together name a word."""
    every = [*keys, *word_keys]
    pairs = overlapping(words.select(*every, "start_ms", "end_ms"), intervals.where(F.col(speaker).isNotNull()).select(*keys, "start_ms", "end_ms", speaker), keys, least=least)
    pairs = pairs.select(*every, "other", "overlap").repartition(*every)  # one shuffle for both groupings and the join
    covered = pairs.groupBy(*every, F.col(f"other.{speaker}").alias("_who")).agg(F.sum("overlap").alias("_ms"))
    best = covered.groupBy(*every).agg(F.max_by("_who", F.struct("_ms", -F.col("_who"))).alias("_who"))
    return words.join(best, every, "left").withColumn(speaker, F.coalesce("_who", F.lit(default))).drop("_who")

"""Vectors of words: lookup with a fallback, and product-quantised codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(words: DataFrame, vectors: DataFrame, word: str = "word", vec: str = "vec", unknown: list[float] | None = None) -> DataFrame:
    """Adds vec by the lower-case word; unknown words get `unknown`.  Of a word that repeats in the table the
    smallest vector counts."""
    table = vectors.groupBy(F.col(word).alias("_k")).agg(F.min(vec).alias(vec))
    out = words.join(table, F.lower(F.col(word)) == F.col("_k"), "left").drop("_k")
    return out if unknown is None else out.withColumn(vec, F.coalesce(vec, F.array(*map(F.lit, unknown))))


def decoded(codes: DataFrame, codebook: DataFrame, key: str = "word", code: str = "codes") -> DataFrame:
    """key, vec: each code's chunk from the codebook (sub, code, chunk), joined in order.  The codebook has a
    fixed size (sub-quantisers times 256 rows), so it is broadcast."""
    each = codes.select(key, F.posexplode(code).alias("sub", "code"))
    met = each.join(F.broadcast(codebook), ["sub", "code"])
    parts = F.sort_array(F.collect_list(F.struct("sub", "chunk")))
    return met.groupBy(key).agg(F.flatten(F.transform(parts, lambda x: x["chunk"])).alias("vec"))


def encoded(vectors: DataFrame, codebook: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """key, codes: for each chunk of `width` components the number of the nearest chunk of the codebook;
    ties go to the smaller number.  The codebook has a fixed size, so it is broadcast as one row, and each
    vector is coded in its own row, without a shuffle."""
    by_sub = codebook.groupBy("sub").agg(F.sort_array(F.collect_list(F.struct("code", "chunk"))).alias("l"))
    book = by_sub.agg(F.transform(F.sort_array(F.collect_list(F.struct("sub", "l"))), lambda x: x["l"]).alias("_book"))

    def off(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, d: t + d)

    def nearest(options, i):
        part = F.slice(vec, i * width + 1, F.lit(width))
        return F.array_min(F.transform(options, lambda o: F.struct(off(part, o["chunk"]).alias("d"), o["code"].alias("code"))))["code"]

    subs = F.slice("_book", F.lit(1), F.floor(F.size(vec) / width).cast("int"))
    return vectors.join(F.broadcast(book)).select(key, F.transform(subs, nearest).alias("codes"))

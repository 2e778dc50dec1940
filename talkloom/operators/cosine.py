"""Pairs of sparse vectors whose product reaches a threshold, by a pruned inverted index.

Within a key, terms are ordered from common to rare.  Of a vector x, as many leading terms stay out of the index as
their products can add up to less than the threshold, whatever vector they meet: a term adds x's weight times the
smaller of the term's largest weight and x's own largest one, since a pair is looked up from its member with the
smaller largest weight.  So a pair that reaches the threshold shares an indexed term of its other member.  Common
terms have small weights and drop out of most vectors' indexes, which is where a plain join is quadratic.  A
candidate's sum over indexed terms, with the bound of what was left out, is tested before the rest is added from
the leading terms.  Weights are not negative, vectors of length 1.

Products are added as multiples of 2 ** -60, which is exact, so that a sum is the same in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Sums in another order differ by less.
SLACK = 1e-9
#: Products are added in parts of this size; one of 0.004 or more loses nothing by that.
PARTS = 2.0**60


def parts(product: Column) -> Column:
    return F.rint(product * PARTS).cast("long")


def split_vectors(weights: DataFrame, key: str, idx: str, threshold: float) -> DataFrame:
    """key, idx, most (the largest weight), head (leading terms), tail (indexed terms), bound (what head can add)."""
    terms = weights.groupBy(key, "term").agg(F.count("*").alias("df"), F.max("w").alias("top"))
    full = weights.join(terms, [key, "term"]).groupBy(key, idx).agg(F.max("w").alias("most"), F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("o"), "term", "w", "top"))).alias("p"))
    add = lambda x: x["w"] * F.least(x["top"], F.col("most"))
    start = F.struct(F.lit(0.0).alias("b"), F.lit(0).alias("k"), F.lit(True).alias("on"))

    def step(a, x):
        on = a["on"] & (a["b"] + add(x) < threshold - SLACK)
        return F.struct(F.when(on, a["b"] + add(x)).otherwise(a["b"]).alias("b"), (a["k"] + F.when(on, 1).otherwise(0)).alias("k"), on.alias("on"))

    cut = full.withColumn("c", F.aggregate("p", start, step))
    slim = lambda c: F.transform(c, lambda x: F.struct(x["term"].alias("term"), x["w"].alias("w")))
    return cut.select(key, idx, "most", slim(F.slice("p", F.lit(1), F.col("c.k"))).alias("head"), slim(F.slice("p", F.col("c.k") + 1, F.size("p"))).alias("tail"), F.col("c.b").alias("bound"))


def met(vectors: DataFrame, key: str, idx: str) -> DataFrame:
    """A row for each indexed term of src that dst has: key, src, dst, product, bound.  src has the larger largest weight."""
    index = vectors.select(key, F.col(idx).alias("src"), F.col("most").alias("ms"), "bound", F.explode("tail").alias("x")).select(key, "src", "ms", "bound", F.col("x.term").alias("term"), F.col("x.w").alias("ws"))
    probe = vectors.select(key, F.col(idx).alias("dst"), F.col("most").alias("md"), F.explode(F.concat("head", "tail")).alias("x")).select(key, "dst", "md", F.col("x.term").alias("term"), F.col("x.w").alias("wd"))
    later = (F.col("md") < F.col("ms")) | ((F.col("md") == F.col("ms")) & (F.col("dst") > F.col("src")))
    return index.join(probe, [key, "term"]).where(later).select(key, "src", "dst", (F.col("ws") * F.col("wd")).alias("product"), "bound")


def cosine_join(weights: DataFrame, threshold: float, key: str = "doc_id", idx: str = "sent_idx", slack: float = SLACK) -> DataFrame:
    """key, src, dst, w of the pairs (each once) with a product of threshold - slack or more.  weights: key, idx, term, w, one
    row a term.  With SLACK a product that equals the threshold but for the rounding of its weights counts; with 0 doubles are
    compared as they are, which is what SQL does."""
    vectors = stored(split_vectors(weights, key, idx, threshold), "cosine-vectors")
    found = met(vectors, key, idx).groupBy(key, "src", "dst").agg(F.sum(parts(F.col("product"))).alias("part"), F.first("bound").alias("bound"))
    found = found.where(F.col("part") / PARTS + F.col("bound") >= threshold - SLACK)
    heads = vectors.where(F.size("head") > 0).select(key, F.col(idx).alias("src"), "head")
    both = found.join(heads, [key, "src"], "left")
    whole = both.where("head is null").select(key, "src", "dst", F.col("part").alias("w"))
    all_ = vectors.select(key, F.col(idx).alias("dst"), F.map_from_entries(F.concat("head", "tail")).alias("m"))
    rest = F.aggregate("head", F.lit(0).cast("long"), lambda a, x: a + parts(x["w"] * F.coalesce(F.try_element_at(F.col("m"), x["term"]), F.lit(0.0))))
    added = both.where("head is not null").join(all_, [key, "dst"]).select(key, "src", "dst", (F.col("part") + rest).alias("w"))
    return whole.unionByName(added).withColumn("w", F.col("w") / PARTS).where(F.col("w") >= threshold - slack)

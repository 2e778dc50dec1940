"""Line de-duplication by content-defined chunks, with DataFrame functions only.

A rolling hash over the hashes of a line and the two before it ends a chunk wherever it is 0 modulo
MODULUS, so the same passage is cut alike wherever it stands.  Chunks of LEAST lines or more whose hash
occurs more than once are compared byte by byte, over all documents; the first occurrence (smallest key,
then place) stays and the others are removed from their texts.

Only hashes are shuffled to find what repeats; then the texts of repeated chunks meet, grouped by hash and
bytes with the smallest place pre-aggregated on each side of the shuffle; last, each document gets the
numbers of its removed chunks.  Edge cases: a null text stays null, with 0 lines; an empty text is one empty
line; a null key is a key like others; rows with equal key and text count as one document; a table without
repeats comes back as it is; other columns stay, and n_lines and the like replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

MODULUS, LEAST = 3, 2


def cut(df: DataFrame, text: str) -> DataFrame:
    """Adds _lines and _ends (the number of the last line of each chunk, ascending)."""
    hashed = F.transform("_lines", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long"))
    zero = F.lit(0).cast("long")
    df = df.withColumn("_lines", F.split(text, "\n", -1)).withColumn("_hashes", hashed)
    before = F.concat(F.array(zero), F.col("_hashes"))
    earlier = F.concat(F.array(zero, zero), F.col("_hashes"))
    rolled = F.transform(
        F.arrays_zip(F.col("_hashes").alias("a"), before.alias("b"), earlier.alias("c")),
        lambda x: (x["a"] + F.lit(31) * x["b"] + F.lit(961) * x["c"]) % 1000003)  # null beyond the last line
    places = F.transform(rolled, lambda r, i: F.when((r % MODULUS == 0) | (i + 1 == F.size("_hashes")), i + 1))
    return df.withColumn("_ends", F.array_compact(F.slice(places, 1, F.size("_hashes")))).drop("_hashes")


def spans() -> Column:
    """Chunks as structs of number, first line and count of lines."""
    starts = F.concat(F.array(F.lit(0)), F.col("_ends"))
    return F.filter(
        F.transform(F.arrays_zip(F.col("_ends").alias("e"), starts.alias("s")),
                    lambda x, i: F.struct(i.alias("number"), (x["s"] + 1).alias("start"), (x["e"] - x["s"]).alias("count"))),
        lambda x: x["count"].isNotNull())


def chunk_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _row (a hash of the text), _number and _chunk of each chunk of LEAST lines or more."""
    df = cut(df.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text")), "_text")
    many = df.select("_key", "_row", "_lines", F.explode(F.filter(spans(), lambda x: x["count"] >= LEAST)).alias("_c"))
    chunk = F.array_join(F.slice("_lines", F.col("_c.start"), F.col("_c.count")), "\n")
    return many.select("_key", "_row", F.col("_c.number").alias("_number"), chunk.alias("_chunk"))


def repeated(df: DataFrame, key: str, text: str) -> DataFrame:
    """_key, _row and _gone (numbers of the chunks to remove) of each document that repeats a chunk."""
    chunks = chunk_texts(df, key, text).withColumn("_hash", F.xxhash64("_chunk"))
    place = F.struct("_key", "_row", "_number")
    # the smallest and the largest place differ where a hash occurs twice
    counted = chunks.groupBy("_hash").agg(F.min(place).alias("_low"), F.max(place).alias("_high"))
    twice = counted.where("not (_low <=> _high)").select("_hash")
    found = written(chunks.join(twice, "_hash", "left_semi"), "line-chunks")
    # a table of its own, so that a chunk that very many documents hold can be split in the join
    first = written(found.groupBy("_hash", "_chunk").agg(F.min(place).alias("_first")), "line-firsts")
    gone = found.join(first, ["_hash", "_chunk"]).where(~place.eqNullSafe(F.col("_first")))
    return gone.groupBy("_key", "_row").agg(F.collect_set("_number").alias("_gone"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with repeated chunks removed from its texts, and n_lines (before), n_removed_lines, n_removed_chunks."""
    made = ("n_lines", "n_removed_lines", "n_removed_chunks")
    gone = repeated(df, key, text).withColumnRenamed("_row", "_gone_row").withColumnRenamed("_key", "_gone_key")
    keep = [c for c in df.columns if c not in made]
    whole = df.select(*keep, F.xxhash64(text).alias("_row"))
    both = whole.join(gone, F.col(key).eqNullSafe(F.col("_gone_key")) & (F.col("_row") == F.col("_gone_row")), "left")
    both = cut(both, text).withColumn("_spans", spans())
    out = F.col("_gone").isNotNull()
    kept = F.filter("_spans", lambda x: ~F.array_contains("_gone", x["number"]))
    lost = F.filter("_spans", lambda x: F.array_contains("_gone", x["number"]))
    joined = F.array_join(F.flatten(F.transform(kept, lambda x: F.slice("_lines", x["start"], x["count"]))), "\n")
    n_lost = F.aggregate(lost, F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return both.select(
        *[F.when(out, joined).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in keep],
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(out, n_lost).otherwise(0).cast("long").alias("n_removed_lines"),
        F.when(out, F.size("_gone")).otherwise(0).cast("long").alias("n_removed_chunks"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = dedup_lines(docs)
    return clean.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS hh FROM l),
r AS (SELECT *, ((hh + 31 * coalesce(lag(hh, 1) OVER w, 0) + 961 * coalesce(lag(hh, 2) OVER w, 0)) % 1000003) % 3 = 0 OR i = n AS fin
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS number FROM r),
k AS (SELECT doc_id, number, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY doc_id, number),
f AS (SELECT *, lines >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, number) > 1 AS gone FROM k)
SELECT doc_id, sum(lines)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed_lines,
       count(*) FILTER (gone)::BIGINT AS n_removed_chunks,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY number) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

"""What the text operators share: reading tables, shared storage, and numpy hashing of whole texts."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MUL = 0x9E3779B97F4A7C15
_U = np.uint64


#: Rows of one Arrow batch to a Python worker; whole texts of some 100 kB make more than this large.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set (local tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if path is None:
        path = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_of(column: str, modulus: int):
    """crc32 of the id as text, modulo: the hold-out rule of the contracts."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def in_runs(batches, columns: list[str], rows: int = 200_000, most: int = 1_000_000):
    """Blocks of whole runs of the first column, which must be sorted; a run of more than `most` rows is cut.
    Gives the block's arrays and whether its first run goes on from the block before."""
    held, n, cont = [], 0, False

    def block(final):
        nonlocal held, n, cont
        data = [np.concatenate([b[i] for b in held]) for i in range(len(columns))]
        end = len(data[0])
        if not final:
            end = int(np.searchsorted(data[0], data[0][-1]))
            if end == 0 and len(data[0]) < most:
                held, n = [data], len(data[0])
                return None
        cut = end == 0
        end = end or len(data[0])
        out, was = [x[:end] for x in data], cont
        cont = cut
        held = [[x[end:] for x in data]] if end < len(data[0]) else []
        n = len(data[0]) - end
        return out, was

    for batch in batches:
        if len(batch):
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            n += len(batch)
            if n >= rows and (got := block(False)):
                yield got
    if n and (got := block(True)):
        yield got


def by_bytes(texts, limit: int = 1 << 20):
    """Index ranges (i, j) of texts whose summed length stays near `limit`."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(texts):
        yield i, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(29))
    h = h * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each k-gram of a, by doubling: log k array passes."""
    cur, span, base = (a.astype(_U) + _U(1)) * _U(0xFF51AFD7ED558CCD), 1, MUL
    res, off = None, 0
    while True:
        if k & span:
            if res is None:
                res = cur
            else:
                n = len(a) - (off + span) + 1
                if n <= 0:
                    return np.empty(0, _U)
                res = res[:n] * _U(base) + cur[off : off + n]
            off += span
        if span * 2 > k:
            return res
        n = len(cur) - span
        if n <= 0:
            return np.empty(0, _U)
        cur = cur[:n] * _U(base) + cur[span : span + n]
        span, base = span * 2, base * base % (1 << 64)


def slide(a: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over each window of w entries, by doubling."""
    m = 1
    while m * 2 <= w:
        a = op(a[:-m], a[m:])
        m *= 2
    return op(a[: len(a) - (w - m)], a[w - m :]) if w > m else a


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=_U)


INV = pow(MUL, -1, 1 << 64)
_POW: list[np.ndarray] = [np.empty(0, _U), np.empty(0, _U)]


def span_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hash of a[start:end] for many non-empty spans, by prefix sums of a[i] * MUL^i (mod 2^64)."""
    n = len(a) + 1
    if len(_POW[0]) < n:
        _POW[0], _POW[1] = powers(MUL, 2 * n), powers(INV, 2 * n)
    pre = np.zeros(n, _U)
    np.cumsum((a.astype(_U) + _U(1)) * _POW[0][: n - 1], out=pre[1:])
    return mix((pre[ends] - pre[starts]) * _POW[1][starts])


def components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "cc") -> DataFrame:
    """Connected components: (node, component) with component the smallest node reachable.

    Alternating large-star and small-star steps: each round is two grouped joins over the edge list,
    edges point to smaller nodes, and the rounds end when the edge list stops changing (about log n).
    Only nodes with an edge appear."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, label)
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = written(small.where("u <> v").distinct(), label)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    out = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return out.union(roots).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))

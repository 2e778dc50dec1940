"""Hard negatives of anchor vectors, exact, by segment summary filtering.

A vector is cut into segments; of each its mean and its deviation (the norm of what is left) are stored.  The product
of two vectors is, segment by segment, length * mean * mean plus the product of what is left, which lies within the
product of the deviations: the sum of the means' products plus or minus the deviations' products bounds the score.
Pairs are bounded on one segment first; what that leaves on SEGMENTS[1], then SEGMENTS[2]; only what then may still
count is scored exactly.  A bound is held against the score of the k-th best so far (an exact score, or the k-th
largest lower bound in the block at hand), so nothing that belongs to the result is dropped.

Two passes over the same blocks: the best rows of an anchor's own label (positives), and, for each window that a
positive's score opens, the best rows of other labels within it.  Rows are packed into chunks of up to ROWS, in
which they are worked through in blocks of BLOCK; anchors into blocks of up to ANCHORS.  A chunk meets each block of
anchors once (anchors are a stated query set): the anchors are broadcast where their size allows it (BROADCAST bytes,
checked), else shuffled to the chunks.  A task keeps the best of its chunk alone, so that what is shuffled after it is
a bounded number of rows for each anchor and chunk.

Vectors are lists of integers (bigint).  Scores are exact; those beyond a bigint are held at its ends.

Edge cases: rows with a null id, label or vector, or a null component, take no part; vectors of different lengths are
compared as if zeros stood behind the shorter one, and a vector of no component has the score 0 with all; rows
with equal ids stay rows of their own, and no row with an anchor's id is its positive or negative; ties of scores go by
id, those of ids by label; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written

ROWS, BLOCK, ANCHORS = 32_768, 1024, 1024
SEGMENTS = (1, 4, 16)
#: Anchors are broadcast up to this size, 8 bytes a component.
BROADCAST = 64 << 20
_PACKED = "n long, d long, row binary, id binary, label binary, vector binary, low binary, high binary, key binary, value binary"


class Rows:
    """Vectors with their ids, labels and the summaries of their segments."""

    def __init__(self, x: np.ndarray, id_: np.ndarray, label: np.ndarray):
        self.x, self.id, self.label = x, id_, label
        f = x.astype(np.float64)
        self.float, self.norm, self.largest = f, np.sqrt(np.einsum("ij,ij->i", f, f)), float(np.abs(f).max(initial=0))
        self.summary = []
        for m in SEGMENTS:
            parts = f.reshape(len(f), m, -1)
            mean = parts.mean(axis=2)
            rest = np.sqrt(np.maximum(np.einsum("ijk,ijk->ij", p := parts - mean[:, :, None], p), 0))
            self.summary.append((mean * np.sqrt(parts.shape[2]), rest))

    def part(self, at: slice) -> Rows:
        out = object.__new__(Rows)
        out.x, out.id, out.label, out.float, out.norm, out.largest = self.x[at], self.id[at], self.label[at], self.float[at], self.norm[at], self.largest
        out.summary = [(m[at], r[at]) for m, r in self.summary]
        return out


def exact(a: Rows, b: Rows, i: np.ndarray, j: np.ndarray, whole: bool) -> np.ndarray:
    """Scores of the pairs (a[i], b[j]); whole: there are so many that all are made at once."""
    most = a.x.shape[1] * a.largest * b.largest
    if most < 2**53:
        if whole:
            return (a.float @ b.float.T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", a.float[i], b.float[j]).astype(np.int64)
    if most < 2**62:
        return np.einsum("ij,ij->i", a.x[i], b.x[j])
    return np.array([max(1 - 2**63, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a.x[p], b.x[q], strict=True)))) for p, q in zip(i, j, strict=True)], np.int64)


def bounds(a: Rows, b: Rows, level: int, i: np.ndarray | None = None, j: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, of all pairs or of those at (i, j)."""
    (ma, ra), (mb, rb) = a.summary[level], b.summary[level]
    if i is None:
        mid, off = ma @ mb.T, ra @ rb.T
    else:
        mid, off = np.einsum("ij,ij->i", ma[i], mb[j]), np.einsum("ij,ij->i", ra[i], rb[j])
    off = off + 1e-10 * float(a.norm.max(initial=0)) * float(b.norm.max(initial=0)) + 1e-6
    return mid - off, mid + off


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, minus infinity where there are fewer than k."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def best_within(a: Rows, chunk: Rows, other: bool, windows: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, ...]]:
    """For each window (smallest, largest score of each anchor): (anchor, row, score) of the anchor's k
    best rows of its own label (other: of other labels) within it, from the chunk."""
    top = [tuple(np.empty(0, np.int64) for _ in range(3)) for _ in windows]
    least = [np.full(len(a.x), -np.inf) for _ in windows]  # score of the k-th best so far
    for at in range(0, len(chunk.x), BLOCK):
        b = chunk.part(slice(at, at + BLOCK))
        may = (a.label[:, None] != b.label[None, :]) if other else (a.label[:, None] == b.label[None, :])
        may &= a.id[:, None] != b.id[None, :]
        low, high = bounds(a, b, 0)
        any_ = np.zeros_like(may)
        for w, (lo, hi) in enumerate(windows):
            sure = np.where(may & (low >= lo[:, None]) & (high <= hi[:, None]), low, -np.inf)
            least[w] = np.maximum(least[w], kth(sure, k))
            any_ |= (high >= np.maximum(lo, least[w])[:, None]) & (low <= hi[:, None])
        i, j = np.nonzero(may & any_)
        for level in range(1, len(SEGMENTS)):
            if len(i) * 16 > may.size:
                low, high = (x[i, j] for x in bounds(a, b, level))
            else:
                low, high = bounds(a, b, level, i, j)
            keep = np.zeros(len(i), bool)
            for w, (lo, hi) in enumerate(windows):
                keep |= (high >= np.maximum(lo, least[w])[i]) & (low <= hi[i])
            i, j = i[keep], j[keep]
        score = exact(a, b, i, j, len(i) * 16 > may.size)
        for w, (lo, hi) in enumerate(windows):
            use = (score >= lo[i]) & (score <= hi[i]) & (score >= least[w][i])
            anchor, row, value = (np.concatenate([x, y]) for x, y in zip(top[w], (i[use], j[use] + at, score[use]), strict=True))
            order = np.lexsort([chunk.label[row], chunk.id[row], -value, anchor])
            anchor = anchor[order]
            place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
            order, anchor = order[place < k], anchor[place < k]
            top[w] = (anchor, row[order], value[order])
            last = place[place < k] == k - 1
            least[w][anchor[last]] = np.maximum(least[w][anchor[last]], value[order][last].astype(np.float64))
    return top


def padded(lists: list[list[int]]) -> np.ndarray:
    """The vectors as a matrix, zeros behind them up to a multiple of the number of segments."""
    d = max(map(len, lists), default=0)
    out = np.zeros((len(lists), -(-max(d, 1) // SEGMENTS[-1]) * SEGMENTS[-1]), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows (row, id, label, vector, and of anchors windows) as blocks of up to `most`, each one row."""

    def run(batches):
        held, n = [], 0

        def block():
            lists = [x for b in held for x in b.column(3).to_pylist()]
            x = padded(lists)
            ids, labels, numbers = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for c in (1, 2, 0))
            rest = [[] for _ in range(4)]
            for b in held:
                for w in b.column(4).to_pylist():
                    w = w or []
                    for out, name in zip(rest, ("low", "high", "key", "value"), strict=True):
                        out.append([v[name] for v in w])
            wide = max((len(r) for r in rest[0]), default=0)
            fill = [np.full((len(ids), wide), v, np.int64) for v in (1, 0, 0, 0)]  # an empty window where there are fewer
            for f, r in zip(fill, rest, strict=True):
                for p, v in enumerate(r):
                    f[p, : len(v)] = v
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([x.shape[1]], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (numbers, ids, labels, x, *fill))],
                                              [c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            for i in range(0, len(batch), most):
                part = batch.slice(i, most)
                if n + len(part) > most:
                    yield block()
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if held:
            yield block()

    return rows.select("row", "id", "label", "vector", "windows").mapInArrow(run, _PACKED)


def unpacked(r: dict, wide: int) -> tuple[Rows, np.ndarray, list[np.ndarray]]:
    n = r["n"]
    x = np.frombuffer(r["vector"], np.int64).reshape(n, -1)
    if x.shape[1] < wide:
        x = np.concatenate([x, np.zeros((n, wide - x.shape[1]), np.int64)], axis=1)
    return Rows(x, np.frombuffer(r["id"], np.int64), np.frombuffer(r["label"], np.int64)), np.frombuffer(r["row"], np.int64), [np.frombuffer(r[c], np.int64).reshape(n, -1) if n else np.empty((0, 0), np.int64) for c in ("low", "high", "key", "value")]


def met(chunks: DataFrame, anchors: DataFrame, other: bool, k: int) -> DataFrame:
    """row (the anchor's), anchor, window, key, value (the window's), id, label, score of the k best in each window."""
    blocks = written(anchors.withColumn("number", F.monotonically_increasing_id()), "negatives-anchors")
    numbers = [r["number"] for r in blocks.select("number").collect()]  # one for each ANCHORS anchors
    size = blocks.agg(F.sum(F.col("n") * F.col("d") * 8)).first()[0] or 0
    every = chunks.withColumn("number", F.explode(F.array(*(F.lit(x).cast("long") for x in numbers)).cast("array<bigint>")))
    both = every.alias("c").join((F.broadcast(blocks) if size <= BROADCAST else blocks).alias("a"), "number")
    names = [f.split()[0] for f in _PACKED.split(", ")]
    pick = [F.struct(*(F.col(f"{t}.{c}").alias(c) for c in names)).alias(t) for t in ("c", "a")]

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                c, a = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                wide = max(c["d"], a["d"])
                chunk, _, _ = unpacked(c, wide)
                query, number, (low, high, key, value) = unpacked(a, wide)
                windows = [(low[:, w], high[:, w]) for w in range(low.shape[1])] if other else [(np.full(len(number), -(2**63)), np.full(len(number), 2**63 - 1))]
                for w, (at, row, score) in enumerate(best_within(query, chunk, other, windows, k)):
                    of = (key[at, w], value[at, w]) if other else (np.zeros(len(at), np.int64),) * 2
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (number[at], query.id[at], np.full(len(at), w, np.int64), *of, chunk.id[row], chunk.label[row], score)],
                                                     ["row", "anchor", "window", "key", "value", "id", "label", "score"])

    found = both.select(*pick).mapInArrow(run, "row long, anchor long, window long, key long, value long, id long, label long, score long")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id", "label")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: str, key: str = "vec_id", label: str = "label", vector: str = "vector", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that is_anchor (SQL over
    id and label) holds for and each of its best `positives`, the best `negatives` rows of other labels with scores from
    low to high per cent of the positive's.  vector: array of bigint."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    rows = rows.where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    none = F.lit(None).cast("array<struct<low:bigint,high:bigint,key:bigint,value:bigint>>")
    anchors = written(rows.where(is_anchor).select(F.monotonically_increasing_id().alias("row"), "id", "label", "vector"), "negatives-queries")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    chunks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    chunks = written(packed(rows.select(F.lit(0).cast("long").alias("row"), "*", none.alias("windows")).repartition(chunks), ROWS), "negatives-chunks")

    best = met(chunks, packed(anchors.withColumn("windows", none).repartition(blocks), ANCHORS), False, positives)
    best = written(best.select("row", "rank", "id", "score"), "negatives-positives")
    # low * p <= 100 * s <= high * p for whole s
    edge = lambda x, share, by: F.expr(f"cast({by}(cast({x} as decimal(38, 0)) * {share} / 100) as decimal(38, 0))").cast("long")
    window = F.struct(edge("score", low, "ceil").alias("low"), edge("score", high, "floor").alias("high"), F.col("id").alias("key"), F.col("score").alias("value"))
    windows = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", window.alias("w")))).alias("l")).select("row", F.transform("l", lambda x: x["w"]).alias("windows"))
    asked = anchors.join(windows, "row").select("row", "id", "label", "vector", "windows").repartition(blocks)
    found = met(chunks, packed(asked, ANCHORS), True, negatives)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        F.col("value").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    rows = rows.where("not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = rows.select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), F.expr("transform(embedding, x -> floor(256 * cast(x as double)))").alias("vector"))
    return hard_negatives(rows, "id % 100 = 0")


OP13_SQL = """
WITH clean AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = list_count(embedding) AND len([x for x in embedding if NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM clean a JOIN clean b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""

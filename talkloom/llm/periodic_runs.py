"""Maximal periodic runs of words, and texts with the repeats of each run taken out.

A run is a stretch of words with smallest period q, of at least max(LEAST, TIMES * q) words, that neither neighbour
extends.  Scale-tiled distribution: periods fall into octaves, [1, 8) and then [2^k, 2^(k+1)).  A document is exploded
into overlapping tiles for each octave, of boundaries a step apart that is no longer than any period of the octave and
so hit every run.  Of these tiles only those are sent where a run may be: within a run every word stretch as long as a
period or longer recurs first at the distance of the period, so stretches whose nearest equal one before lies within
the octave mark the boundaries.  Stretches are compared exactly, by ranks that double in length, not by hashes.

Each tile is solved by itself (`solve`): at a boundary, Z-functions of the words to its right and of the reversed
words to its left give, for all periods of the octave, how far the stretch around the boundary keeps the period.  The
interval fragments are shuffled by document and period; fragments of one period that overlap by a period or more are
one run (`stitch`), and fragments of any two different runs overlap by less.  So a long document is solved by many
tasks, and what meets in a group is a few fragments for each tile (one tile's are joined before the shuffle).

Work and memory: a batch of documents is ranked in log(length / 3) sorts of those words only that recur; a document's
words are held whole in the task that explodes it.

Edge cases: null and empty texts have no words, no runs and an empty collapsed text; rows with equal or null keys are
told apart by a number of their own, so each row has its own result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import by_bytes, small_batches, table, written

LEAST, TIMES = 24, 3
#: The first octave holds the periods below FIRST; its boundaries are FIRST words apart.
FIRST = 8
#: Words between the first and the last boundary of a tile, at least; 16 steps of larger octaves.
TILE = 2048
SPACE = "[\\x20\\x09-\\x0D]+"


def octave(k: int) -> tuple[int, int, int, int, int]:
    """Periods from, to (exclusive); length of the stretches that mark runs; step of boundaries; reach of a tile on
    either side of a boundary.  For octaves above the first a run of 3q words holds a stretch of 2 * 2^k with an
    equal one a period before; in the first, 24 words hold one of 24 - 7."""
    if k == 0:
        return 1, FIRST, LEAST - FIRST + 1, FIRST, LEAST
    low = FIRST << (k - 1)
    return low, 2 * low, 2 * low, low, 2 * low


def numbered(texts: list[str | None], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts, one after another, equal for equal words of one text only, and where each
    text starts; a number of its own stands behind each text."""
    parts, starts, at = [], [0], first
    for text in texts:
        known: dict[bytes, int] = {}
        words = [known.setdefault(w, len(known)) for w in (text or "").encode().split()]
        own = np.empty(len(words) + 1, np.int64)
        own[:-1] = words
        own[-1] = len(known)
        parts.append(own + at)
        at += len(known) + 1
        starts.append(starts[-1] + len(own))
    return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(starts)


def ranked(key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys that occur more than once, and their positions (ascending)."""
    _, rank, n = np.unique(key, return_inverse=True, return_counts=True)
    keep = n[rank] > 1
    return rank[keep], pos[keep]


class Stretches:
    """Positions of stretches of some length that occur more than once, with ranks that are equal for equal ones."""

    def __init__(self, size: int, length: int, rank: np.ndarray, pos: np.ndarray):
        self.size, self.length, self.rank, self.pos = size, length, rank, pos

    def longer(self, by: int) -> Stretches:
        """Those of length + by, by up to length: equal where both stretches that cover them are."""
        at = np.full(self.size + by, -1, np.int64)
        at[self.pos] = self.rank
        second = at[self.pos + by]
        have = second >= 0
        base = int(self.rank.max()) + 1 if len(self.rank) else 1
        return Stretches(self.size, self.length + by, *ranked(self.rank[have] * base + second[have], self.pos[have]))

    def recurring(self, low: int, high: int) -> np.ndarray:
        """Positions whose nearest equal stretch before is at a distance in [low, high)."""
        order = np.lexsort([self.pos, self.rank])
        rank, pos = self.rank[order], self.pos[order]
        gap = np.diff(pos)
        return np.sort(pos[1:][(rank[1:] == rank[:-1]) & (gap >= low) & (gap < high)])


def marked(ids: np.ndarray):
    """For each octave, the positions that mark runs; ids as of `numbered`."""
    now, k = Stretches(len(ids), 1, *ranked(ids, np.arange(len(ids)))), 0
    while len(now.pos):
        low, high, length, _, _ = octave(k)
        while now.length * 2 <= length:
            now = now.longer(now.length)
        yield k, (now.longer(length - now.length) if now.length < length else now).recurring(low, high)
        k += 1


def tiles(ids: np.ndarray, starts: np.ndarray):
    """(text, octave, first word of the tile, boundaries, words) of each tile in which a run may be; places are
    counted from the start of the text."""
    ends = starts[1:] - 1
    for k, seeds in marked(ids):
        _, high, _, step, reach = octave(k)
        if not len(seeds):
            continue
        text = np.searchsorted(starts, seeds, "right") - 1
        place = seeds - starts[text]
        place = ((place + step - 1) if k == 0 else place) // step * step
        size = max(TILE, 16 * step)
        cell = np.unique(np.stack([text, place // size, place]), axis=1)
        cuts = np.flatnonzero(np.append(True, np.any(cell[:2, 1:] != cell[:2, :-1], axis=0)))
        for i, j in zip(cuts, np.append(cuts[1:], cell.shape[1]), strict=True):
            t, bounds = int(cell[0, i]), cell[2, i:j]
            n = int(ends[t] - starts[t])
            first, last = max(0, int(bounds[0]) - reach), min(n, int(bounds[-1]) + high + reach)
            yield t, k, first, bounds, ids[starts[t] + first : starts[t] + last]


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of s and s[i:], for each i; 0 at 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        m = min(right - i, z[i - left]) if i < right else 0
        while i + m < n and s[m] == s[i + m]:
            m += 1
        z[i] = m
        if i + m > right:
            left, right = i, i + m
    return z


def primitive(root: np.ndarray) -> bool:
    """Whether no shorter stretch, repeated, makes root."""
    n, rest, f = len(root), len(root), 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            while rest % f == 0:
                rest //= f
            d = n // f
            if np.array_equal(root[d:], root[:-d]):
                return False
        f += 1
    return True


def solve(k: int, first: int, bounds: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, start, end) of the stretches around the boundaries of a tile that keep a smallest period of the
    octave for two periods or more; those of one period that overlap by a period are one."""
    low, high, _, _, reach = octave(k)
    s, n, found = words.tolist(), len(words), []
    for c in (bounds - first).tolist():
        right = z_function(s[c : c + high + reach])
        back = s[max(0, c - reach) : c][::-1]
        forth = s[max(0, c - reach) : c + high][::-1]
        left = z_function([*back, -1, *forth])
        for p in range(low, min(high, n - c)):
            ahead = min(right[p], reach) if p < len(right) else 0
            behind = len(back) + 1 + (len(forth) - len(back) - p)
            # the reversed words before c + p start where those from c on end
            before = left[behind] if len(back) < behind < len(left) else 0
            if ahead + before >= p and primitive(words[c - before : c - before + p]):
                found.append((p, first + c - before, first + c + p + ahead))
    out: list[tuple[int, int, int]] = []
    for p, start, end in sorted(found):
        if out and out[-1][0] == p and out[-1][2] - start >= p:
            out[-1] = (p, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((p, start, end))
    return out


def scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each of df's rows (octave null): _row, key, n, and the text where it may have runs, else the
    hash of its words joined by spaces; and a row for each tile: _row, octave, first, bounds, words."""
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = (rows.select("_row", "_key", F.lit(None).cast("long").alias("n"), "_text", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("int").alias("octave"),
                          F.lit(None).cast("long").alias("first"), F.lit(None).cast("binary").alias("bounds"), F.lit(None).cast("binary").alias("words")).schema)
    arrow = to_arrow_schema(schema)
    key_type = arrow.field("_key").type

    def run(batches):
        for batch in batches:
            numbers, keys, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for lo, hi in by_bytes(texts):
                ids, starts = numbered(texts[lo:hi])
                own, size = numbers.slice(lo, hi - lo), hi - lo
                cells = list(tiles(ids, starts))
                may = {c[0] for c in cells}
                sha = [None if t in may else hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for t, x in enumerate(texts[lo:hi])]
                none = lambda n, kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays([own, keys.slice(lo, size).cast(key_type), pa.array(np.diff(starts) - 1), pa.array([texts[lo + t] if t in may else None for t in range(size)], pa.string()),
                                                  pa.array(sha, pa.string()), none(size, pa.int32()), none(size, pa.int64()), none(size, pa.binary()), none(size, pa.binary())], schema=arrow)
                for i in range(0, len(cells), 64):
                    part = cells[i : i + 64]
                    m = len(part)
                    small = [(c[4] - c[4].min()).astype(np.uint32) for c in part]
                    yield pa.RecordBatch.from_arrays([pa.array([own[c[0]].as_py() for c in part], pa.int64()), none(m, key_type), none(m, pa.int64()), none(m, pa.string()), none(m, pa.string()),
                                                      pa.array([c[1] for c in part], pa.int32()), pa.array([c[2] for c in part], pa.int64()), pa.array([c[3].astype(np.int64).tobytes() for c in part], pa.binary()),
                                                      pa.array([w.tobytes() for w in small], pa.binary())], schema=arrow)

    return rows.mapInArrow(run, schema)


def fragments(scanned: DataFrame) -> DataFrame:
    """_row, period, start, end of what each tile finds; tiles are dealt out evenly, so a long document's too."""
    cells = scanned.where("octave is not null").select("_row", "octave", "first", "bounds", "words").repartition(F.col("_row"), F.col("octave"), F.col("first"))

    def run(batches):
        for batch in batches:
            row, period, start, end = [], [], [], []
            for i in range(len(batch)):
                r, k, first, bounds, words = (batch.column(j)[i].as_py() for j in range(5))
                for p, a, b in solve(k, first, np.frombuffer(bounds, np.int64), np.frombuffer(words, np.uint32).astype(np.int64)):
                    row.append(r), period.append(p), start.append(a), end.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, period, start, end)], ["_row", "period", "start", "end"])

    return cells.mapInArrow(run, "_row long, period long, start long, end long")


def stitch(found: DataFrame) -> DataFrame:
    """_row, start, length, period of the runs: fragments of a document and period that overlap by a period or more
    are one, and those too short for a run go."""
    order = Window.partitionBy("_row", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = found.select("*", F.when(reached - F.col("start") >= F.col("period"), 0).otherwise(1).alias("new"))
    runs = new.select("*", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("part")).groupBy("_row", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    long = F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST), TIMES * F.col("period"))
    return runs.where(long).select("_row", "start", (F.col("end") - F.col("start")).alias("length"), "period")


def scanned_runs(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    small_batches(df.sparkSession)
    scanned = written(scan(df, key, text), "runs-scan")
    return scanned, stitch(fragments(scanned))


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row (a number of the row), start, length, period (in words) of every run."""
    scanned, runs = scanned_runs(df, key, text)
    names = scanned.where("octave is null").select("_row", F.col("_key").alias(key))
    return runs.join(names, "_row").select(key, F.col("_row").alias("row"), "start", "length", "period")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those of a run behind its first period.  runs: (start, length, period)."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)


def without_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key with runs (start, length, period, by start and period), the strongest of them (greatest exact
    length over period, then the smallest start, then the smallest period; null where there is none), and, of texts
    with runs, the collapsed text; collapsed_sha256 is that of every row (UTF-8, lower-case hex)."""
    scanned, runs = scanned_runs(df, key, text)
    rows = scanned.where("octave is null").select("_row", "_key", "_text", "sha")
    each = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    plain = rows.where("sha is not null")
    may = rows.where("sha is null").join(each, "_row", "left").select("_key", "_text", "runs")
    run_type = "struct<start:bigint,length:bigint,period:bigint>"
    schema = may.select("_key", F.lit(None).cast(f"array<{run_type}>").alias("runs"), F.lit(None).cast(run_type).alias("strongest"), F.lit(None).cast("string").alias("collapsed"), F.lit(None).cast("string").alias("collapsed_sha256")).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in by_bytes(texts):
                best, left, sha = [], [], []
                for t, found in zip(texts[lo:hi], lists[lo:hi], strict=True):
                    found = found or []
                    best.append(min(found, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None))
                    rest = collapsed((t or "").encode().split(), [(r["start"], r["length"], r["period"]) for r in found])
                    left.append(rest.decode() if found else None)
                    sha.append(hashlib.sha256(rest).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(arrow.field(0).type), pa.array([x or [] for x in lists[lo:hi]], arrow.field(1).type), pa.array(best, arrow.field(2).type),
                                                  pa.array(left, pa.string()), pa.array(sha, pa.string())], schema=arrow)

    done = may.mapInArrow(run, schema)
    none = plain.select("_key", F.array().cast(f"array<{run_type}>").alias("runs"), F.lit(None).cast(run_type).alias("strongest"), F.lit(None).cast("string").alias("collapsed"), F.col("sha").alias("collapsed_sha256"))
    return done.union(none).withColumnRenamed("_key", key)


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text by the query's contract: every tenth document's words from one on repeat a stretch of it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    n = F.size("w").cast("long")
    docs = docs.select("doc_id", "text", F.when(F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull(), words).alias("w"), g.alias("g"))
    docs = docs.select("*", F.when(n > 0, F.col("g") % n).alias("a"))
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long")
    docs = docs.select("*", F.when(n > 0, p).alias("p"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("a") - 1), lambda i: F.element_at("w", (F.col("a") + i % F.col("p") + 1).cast("int")))
    periodic = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail)
    return docs.select("doc_id", F.when(n > 0, F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = without_runs(made_periodic(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("strongest")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")

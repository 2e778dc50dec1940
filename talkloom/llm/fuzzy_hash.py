"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes triggers a boundary wherever it is -1 modulo the block size; each
piece between boundaries gives one of 64 signs, so an edit changes the signs near it and no others.  A
fingerprint is "block:signs:signs at twice the block".  The block is the smallest of 3 * 2^i that keeps
at most 64 signs, halved while fewer than 32 come out.  Two fingerprints are compared at their common
block sizes: 1 - distance / (both lengths), with the edit distance of insertions and deletions, and 0
where they share no run of COMMON signs (half of the shorter one, if that is less).

Edge cases: null and empty texts give "3::", which is like itself (1.0) and unlike all else (0.0).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, span_hashes, table, written

WINDOW, SIGNS, LEAST, COMMON, RANGE = 7, 64, 3, 5, 8000
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def triggers(a: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted xor of the last 7 bytes."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), a.astype(np.uint32)])
    n = len(a)
    total, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for age in range(WINDOW):
        c = padded[WINDOW - 1 - age : WINDOW - 1 - age + n]
        total += c
        weighted += np.uint32(WINDOW - age) * c
        shifted ^= c << np.uint32(5 * age)
    return total + weighted + shifted


def signs(a: np.ndarray, ends: np.ndarray, most: int) -> str:
    """One sign per piece; what follows the last of `most` pieces belongs to it."""
    cuts = ends[: most - 1]
    if not len(cuts) or cuts[-1] < len(a):
        cuts = np.append(cuts, len(a))
    starts = np.concatenate([[0], cuts[:-1]])
    return ALPHABET[(span_hashes(a, starts, cuts) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    if not data:
        return f"{LEAST}::"
    a = np.frombuffer(data, np.uint8)
    rolled = triggers(a)
    block = LEAST
    while block * SIGNS < len(a):
        block *= 2
    hit = np.flatnonzero(rolled % np.uint32(LEAST) == LEAST - 1)  # any larger block's boundary is one of these
    at = rolled[hit]
    while True:
        own = hit[at % np.uint32(block) == block - 1] + 1
        if block == LEAST or len(own) >= SIGNS // 2:
            break
        block //= 2
    twice = hit[at % np.uint32(2 * block) == 2 * block - 1] + 1
    return f"{block}:{signs(a, own, SIGNS)}:{signs(a, twice, SIGNS // 2)}"


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), max(1, int(n.max(initial=0)))), np.uint8)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer("".join(strings).encode(), np.uint8)
    return out, n


def sign_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distance of many pairs at once, a row of the table per step."""
    a, n = codes(left)
    b, m = codes(right)
    rows, width = np.arange(len(left)), b.shape[1]
    cost = np.tile(np.arange(width + 1, dtype=np.int16), (len(left), 1))
    run, longest = np.zeros((len(left), width + 1), np.int16), np.zeros(len(left), np.int16)
    dist = cost[rows, m].copy()
    column = np.arange(width + 1, dtype=np.int16)
    inside = np.arange(width) < m[:, None]
    for i in range(a.shape[1]):
        same = (b == a[:, i : i + 1]) & inside & (i < n)[:, None]
        step = np.minimum(cost[:, 1:] + 1, cost[:, :-1] + np.where(same, 0, 2).astype(np.int16))
        step = np.concatenate([cost[:, :1] + 1, step], axis=1) - column
        cost = (np.minimum.accumulate(step, axis=1) + column).astype(np.int16)
        ends = n == i + 1
        dist[ends] = cost[ends, m[ends]]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        longest = np.maximum(longest, run.max(axis=1))
    shorter = np.minimum(n, m)
    enough = (longest >= np.minimum(COMMON, (shorter + 1) // 2)) & (shorter > 0)
    return np.where(enough, 1 - dist / np.maximum(n + m, 1), 0.0)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(left, right, strict=True)])
    at, a, b = [], [], []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x == y:
            continue
        (p, x1, x2), (q, y1, y2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for block, s in ((p, x1), (2 * p, x2)):
            for other, t in ((q, y1), (2 * q, y2)):
                if block == other:
                    at.append(i)
                    a.append(s)
                    b.append(t)
    for lo in range(0, len(at), 4096):
        np.maximum.at(out, at[lo : lo + 4096], sign_likeness(a[lo : lo + 4096], b[lo : lo + 4096]))
    return out


def compare_with_edited(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = RANGE) -> DataFrame:
    """Fingerprints of each text and of its edited form (its second half replaced by the head of its
    successor by key), and likenesses to the edited form and to the successor.  Null keys come first.

    Rows are dealt to ranges of about `rows` rows by key and sorted, so a row's successor stands right after
    it; the first and the last row of each range are kept besides, and a second, small step pairs the last
    row of a range with the first of the next range that has rows (after the last: the first)."""
    df = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = dict(df.dtypes)["_key"]
    names = ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"_key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows_of(ids, texts, prints, nexts, next_prints):
        edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, nexts, strict=True)]
        raw = [t.encode() for t in edited]
        edited_prints = [fingerprint(b) for b in raw]
        return pd.DataFrame(dict(zip(names, [
            ids, list(map(len, texts)), [hashlib.sha256(b).hexdigest() for b in raw], prints, edited_prints,
            likeness(prints, edited_prints), likeness(prints, next_prints)], strict=True)))

    def whole(pdf):
        return pd.DataFrame({c: pdf[c] if c in pdf else pd.Series([None] * len(pdf), dtype=object) for c in every})

    def ends(kind, part, id_, text_):
        return whole(pd.DataFrame({"_key": [id_], "_end": [kind], "_part": [part], "_text": [text_]}))

    def run(batches):
        held, part = None, TaskContext.get().partitionId()  # held: the row before the batch
        for pdf in batches:
            texts = pdf["_text"].tolist()
            for lo, hi in by_bytes(texts):
                ids, own = pdf["_key"].tolist()[lo:hi], texts[lo:hi]
                prints = [fingerprint(t.encode()) for t in own]
                if held is None:
                    yield ends("first", part, ids[0], own[0])
                else:
                    ids, own, prints = ([h, *x] for h, x in zip(held, (ids, own, prints), strict=True))
                if len(ids) > 1:
                    yield whole(rows_of(ids[:-1], own[:-1], prints[:-1], own[1:], prints[1:]))
                held = (ids[-1], own[-1], prints[-1])
        if held is not None:
            yield ends("last", part, *held[:2])

    def pair(batches):
        for pdf in batches:
            prints, nexts = ([fingerprint(t.encode()) for t in pdf[c]] for c in ("_text", "_next"))
            yield rows_of(pdf["_key"].tolist(), pdf["_text"].tolist(), prints, pdf["_next"].tolist(), nexts)

    every = [*names, "_end", "_part", "_text"]
    parts = max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(parts, F.col("_key").asc_nulls_first()).sortWithinPartitions(F.col("_key").asc_nulls_first(), "_text")
    found = written(dealt.mapInPandas(run, f"{schema}, _end string, _part int, _text string"), "fingerprints")
    first = found.where("_end = 'first'").select("_part", F.col("_text").alias("_next"))
    follows = first.select("_part", F.coalesce(F.lead("_part").over(Window.orderBy("_part")), F.min("_part").over(Window.partitionBy())).alias("_after"))  # a number a range
    last = found.where("_end = 'last'").select("_key", "_text", "_part").join(follows, "_part")
    last = last.join(first.withColumnRenamed("_part", "_after"), "_after").select("_key", "_text", "_next")
    out = found.where("_end IS NULL").select(*names).unionByName(last.mapInPandas(pair, schema))
    return out.select(F.col("_key").alias(key), *names[1:])


def op3_fuzzy_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare_with_edited(table(spark, sf_dir, "documents"))

"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from talkloom.llm import periodic_runs as runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    fail = [0] * len(w)
    for i in range(1, len(w)):
        j = fail[i - 1]
        while j and w[i] != w[j]:
            j = fail[j - 1]
        fail[i] = j + (w[i] == w[j])
    return len(w) - fail[-1]


def brute(w):
    """All runs (start, length, period), by start and period."""
    out, n = set(), len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and smallest_period(w[i : j + q]) == q:
                out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def digest(w, found):
    gone = set()
    for start, length, period in found:
        gone.update(range(start + period, start + length))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
    kept = hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha, kept)


def odd_words(rng):
    """Words with nested and touching repetitions, over few or many letters."""
    out = []
    while len(out) < rng.choice([0, 5, 30, 200, 900]):
        letters = rng.choice([1, 2, 3, 40])
        root = [f"x{rng.randrange(letters)}" for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
        if rng.random() < 0.3:
            root = root * rng.randint(2, 9) + [rng.choice("abc")]
        times = rng.choice([1, 2, 2.5, 3, 3.4, 4, 9, 20])
        out += (root * 25)[: int(len(root) * times)]
        if rng.random() < 0.3:
            out += [f"y{rng.randrange(50)}" for _ in range(rng.randint(1, 30))]
    return out


def test_runs_by_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, odd_words(rng)) for i in range(250)]
    rows.append((250, ["same"] * 5000))
    rows.append((251, [f"long{i % 2500}" for i in range(9000)]))
    df = spark.createDataFrame([(i, " \n".join(w)) for i, w in rows], "doc_id long, text string")
    got = {}
    for r in runs.periodic_runs(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["period"]))
    want = {i: brute(w) for i, w in rows if i < 250} | {250: [(0, 5000, 1)], 251: [(0, 9000, 2500)]}
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
    assert sum(map(len, want.values())) > 200 and len({q for x in want.values() for _, _, q in x}) > 20


def test_small_tiles(spark, monkeypatch):
    """Runs that cross many tiles are stitched."""
    monkeypatch.setattr(runs, "TILE", 1)
    rng = random.Random(12)
    rows = [(i, odd_words(rng)) for i in range(60)] + [(60, [f"w{i % 9}" for i in range(2000)] + [f"v{i % 100}" for i in range(2000)])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {}
    for r in runs.periodic_runs(df).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["period"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, w in rows if (x := brute(w))}


def by_contract(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_query_by_brute_force(spark, sf, documents):
    rows = documents.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        w = by_contract(r["doc_id"], r["text"])
        if len(w) <= 3000:
            want[r["doc_id"]] = digest(w, brute(w))
    got = {r["doc_id"]: tuple(r)[1:] for r in runs.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(rows) and len(want) > 150 and sum(x[0] > 0 for x in want.values()) > 8
    assert {i: got[i] for i in want} == want


def test_edge_cases(spark, odd, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["runs"]), r["collapsed_sha256"]) for r in runs.without_runs(odd).collect())
    rows = odd.select("doc_id", "text").collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, *digest(w := WORD.findall(r["text"] or ""), brute(w) if len(w) < 2000 else [(0, 40000, 5)] if not r["text"].endswith("end") else [(0, 40000, 5)])[::6]) for r in rows)
    assert got == want
    assert runs.without_runs(empty).count() == 0 and runs.periodic_runs(empty).count() == 0
    assert runs.without_runs(odd).columns[:1] == ["doc_id"]


@pytest.mark.parametrize("root, whole", [("a", True), ("ab", True), ("abab", False), ("aab", True), ("abcabc", False), ("aaaaa", False), ("abcdabce", True)])
def test_primitive(root, whole):
    assert runs.primitive(np.array([ord(c) for c in root])) == whole

"""Operators that compare documents."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import jaccard_join, line_dedup, nn_descent, suffix_dedup
from talkloom.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(seed: int, n: int = 160):
    """Families of edited copies, common lines, short and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(9)) for _ in range(3)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        text = " ".join(w)
        out.append((i, (rng.choice(lines) + "\n" if rng.random() < 0.4 else "") + (text.upper() if rng.random() < 0.1 else text)))
    return out


def shingle_sets(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return sets


def linked_groups(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("cap, seed", [(48, 1), (2, 2)])
def test_join_by_brute_force(spark, monkeypatch, cap, seed):
    """A small CAP sends the families through one-deletion neighbourhoods and blocks."""
    monkeypatch.setattr(jaccard_join, "CAP", cap)
    monkeypatch.setattr(jaccard_join, "SHINGLES", 1500)
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = shingle_sets(rows)
    want = linked_groups(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < len(want)


def test_join_edge_cases(spark, odd, empty):
    got = {}
    for r in jaccard_join.near_duplicates(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[1] == got[2][:0] + [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(0, 3)] and got[5] == [(1, 5)]
    assert got[13] == [(1, 13)] * 2 and got[14] == [(1, 13)] and got[10][0][1] == 9 and got[None] == [(None, None)]
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_pigeonhole_never_misses():
    """Linked sets agree in a segment that either side shows, in a partition where both take part."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, len(a) // 6 + 1))):
            b[int(rng.integers(0, len(b)))] = rng.integers(0, 1 << 63)
        b = np.unique(b[: len(b) - int(rng.integers(0, len(b) // 8 + 1))])
        common = len(np.intersect1d(a, b))
        if len(b) and jaccard_join.linked(common, len(a), len(b)):
            shown = [{(band, int(s)) for _, band, allowed in jaccard_join.shows(x) for s in jaccard_join.signatures(x, band, allowed)[0]} for x in (a, b)]
            assert shown[0] & shown[1]


def test_short_texts_around_a_hub(spark):
    """A hub whose shingles all fall into one segment needs empty ones, which its many partners don't show."""
    rows, hubs = [], 0
    for t in range(400):
        for words in (7, 8):
            hub = [f"t{t}x{words}x{i}" for i in range(words)]
            s = jaccard_join.shingles(" ".join(hub))
            lacks = any(len(set(((jaccard_join.mix(s + np.uint64(0xD6E8FEB86659FD93 * (band + 1) % 2**64)) >> np.uint64(20)) % np.uint64(jaccard_join.segments_of(band))).tolist())) <= allowed
                        for _, band, allowed in jaccard_join.shows(s))
            if lacks and hubs < 6:
                hubs += 1
                rows += [" ".join(hub)] + [" ".join([*hub, f"v{i}"]) for i in range(60 + 20 * hubs)]
    rows = list(enumerate(rows))
    want = linked_groups(shingle_sets(rows))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert hubs == 6 and got == want and len(set(want.values())) == 6


def groups(spark, rows):
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)


def test_hub_whose_shingles_share_a_segment(spark):
    """Ten words in one segment of their band, and 120 copies that add two words in the two others."""
    hub = "w1827 w4338 w1609 w1088 w1288 w3454 w4897 w2604 w535 w3423"
    rows = [(0, hub)] + [(i, f"{hub} x{i} y{i}") for i in range(1, 121)]
    sets = shingle_sets(rows)
    want = linked_groups(sets)
    assert groups(spark, rows) == [(d, len(sets[d]), want[d]) for d in sorted(sets)]


def test_families_of_short_texts(spark, monkeypatch):
    """Templates of 5 to 12 words with 60 to 200 variants each, beyond CAP."""
    monkeypatch.setattr(jaccard_join, "CAP", 12)
    rng = random.Random(21)
    texts = []
    for words in range(5, 13):
        base = [f"b{words}x{i}" for i in range(words)]
        texts.append(" ".join(base))
        for i in range(rng.randint(60, 200)):
            w = list(base)
            for _ in range(rng.randint(1, 2)):
                w.insert(rng.choice([0, len(w)]), f"v{rng.randrange(40)}")
            texts.append(" ".join(w))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = shingle_sets(rows)
    want = linked_groups(sets)
    assert groups(spark, rows) == [(d, len(sets[d]), want[d]) for d in sorted(sets)]


def families(seed: int, n: int = 2000):
    """Families of sub-templates, each of them a template with up to three words replaced, and variants of those by one or two edits; some drift on from the variant before."""
    rng = random.Random(seed)
    texts, word = [], lambda: f"s{seed}w{rng.randrange(3000)}"
    while len(texts) < n:
        base = [word() for _ in range(rng.randint(8, 40 + 10 * seed))]
        for _ in range(rng.randint(1, 5)):
            sub = list(base)
            for _ in range(rng.randint(0, 3)):
                sub[rng.randrange(len(sub))] = word()
            w = sub
            for _ in range(rng.randint(1, 6)):
                w = list(w if seed % 2 else sub)
                for _ in range(rng.randint(1, 2)):
                    at = rng.randrange(len(w))
                    w[at : at + rng.randint(0, 1)] = [word()]
                texts.append(" ".join(w))
    return texts


def joined_by_index(sets):
    """linked_groups by an inverted index, for larger tables."""
    root, index = {d: d for d in sets}, {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d in sorted(sets):
        shared = {}
        for g in sets[d]:
            for e in index.setdefault(g, []):
                shared[e] = shared.get(e, 0) + 1
            index[g].append(d)
        for e, both in shared.items():
            if 100 * both >= 75 * (len(sets[d]) + len(sets[e]) - both):
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("cap", [3, 48])
def test_random_families(spark, monkeypatch, cap):
    """Members of blocks that no candidate pair names keep their links; ids at random."""
    monkeypatch.setattr(jaccard_join, "CAP", cap)
    texts = [t for seed in range(1, 7) for t in families(seed)]
    rows = sorted(zip(random.Random(cap).sample(range(10 * len(texts)), len(texts)), texts, strict=True))
    sets = shingle_sets(rows)
    want = joined_by_index(sets)
    lost, links_of = [], jaccard_join.block_links

    def watched(members, have):
        lost.append(members.join(have, "doc", "left_anti").count())
        return links_of(members, have)

    monkeypatch.setattr(jaccard_join, "block_links", watched)
    got = groups(spark, rows)
    assert lost == [0]
    assert [x for x in got if x[2] != want[x[0]]] == [] and got == [(d, len(sets[d]), want[d]) for d in sorted(sets)]


def test_equal_keys_with_other_texts(spark):
    """Rows of a key stand for one document by the union of their links."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (7, c), (7, c), (8, c), (4, b), (4, "")]
    assert groups(spark, rows) == sorted([(1, 26, 1), (5, 26, 1), (5, 26, 1), (9, 27, 1), (7, 26, 7), (7, 26, 7), (8, 26, 7), (4, 26, 1), (4, 0, 4)])


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) // 8 + 1)):], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 8 + 1))).astype(np.uint64)]))
        x, y = jaccard_join.parity(a), jaccard_join.parity(b)
        while len(x) != len(y):
            x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_long_words_do_not_collide_by_structure():
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    assert jaccard_join.shingles(thue) != jaccard_join.shingles(thue.translate(str.maketrans("ab", "ba")))


def brute_passages(rows):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 49):
            if seen.setdefault(b[i : i + 50], d) != d:
                cover[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, f in zip(b, cover, strict=True) if not f)
        out[d] = (len(b), len(b) - len(kept), len([s for s in bytes(cover).split(b"\0") if s]), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcdé 日") for _ in range(rng.randint(40, 200))) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s))
            parts += ["".join(rng.choice("xyz ") for _ in range(rng.randint(0, 40))), s[cut:] if rng.random() < 0.5 else s[: cut + 1]]
        rows.append((i, "".join(parts)))
    return rows + [(80, "ab" * 200), (81, "ab" * 90), (82, "q" * 400), (83, rows[3][1]), (84, "")]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_passages_by_brute_force(spark, hot):
    rows = passages(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_dedup.remove_repeats(df, hot=hot).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out}
    assert got == brute_passages(rows)


def test_passages_with_equal_keys_and_long_repeats(spark):
    """Rows of a key don't remove each other's bytes; repeats of several thousand bytes are removed whole."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b, long = word(200), word(300), word(6000)
    rows = [(1, a), (5, a), (5, b), (9, b + "more"), (9, b + "more"), (2, "x" + long + "y"), (6, word(70) + long), (7, long[3000:] + word(10) + long[:2500]), (3, b[:40])]
    earlier = lambda d: {t[i : i + 50] for k, t in rows if k < d for i in range(len(t) - 49)}
    want = []
    for d, t in rows:
        seen, cover = earlier(d), bytearray(len(t))
        for i in range(len(t) - 49):
            if t[i : i + 50] in seen:
                cover[i : i + 50] = b"\1" * 50
        want.append((d, len(t), sum(cover), "".join(c for c, x in zip(t, cover, strict=True) if not x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _key", "2 AS _sha", "3 AS _gone", "4 AS _marks")
    out = suffix_dedup.remove_repeats(df)
    assert out.columns == ["doc_id", "_key", "_sha", "_gone", "_marks", "kept", "n_bytes", "n_removed", "n_spans"]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]).decode()) for r in out.collect()) == sorted(want)


def test_passage_edge_cases(spark, odd, empty):
    got = {}
    for r in suffix_dedup.as_text(suffix_dedup.remove_repeats(odd)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == odd.count() and got[2][0]["n_bytes"] == 0 and got[None][0]["n_removed"] == 0
    assert got[10][0]["n_removed"] > 50_000 and got[9][0]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_runs_are_cut_only_when_long():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([1, 1, 2, 2]), pa.array([0, 1, 2, 3])], ["k", "v"]), pa.RecordBatch.from_arrays([pa.array([2, 2, 3]), pa.array([4, 5, 6])], ["k", "v"])]
    whole = [(k.tolist(), v.tolist(), c) for (k, v), c in suffix_dedup.in_runs(iter(batches), ["k", "v"], rows=3)]
    assert whole == [([1, 1], [0, 1], False), ([2, 2, 2, 2], [2, 3, 4, 5], False), ([3], [6], False)]
    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(k)], ["k", "v"]) for k in ([1, 1, 2, 2], [2, 2], [2, 3])]
    cut = [(k.tolist(), c) for (k, _), c in suffix_dedup.in_runs(iter(batches), ["k", "v"], rows=2, most=2)]
    assert cut == [([1, 1], False), ([2, 2, 2, 2], False), ([2], True), ([3], False)]


def test_intervals_are_maximal_repeats():
    parts = [b"x" * 3 + bytes(range(60)), b"y" * 3 + bytes(range(60)), b"z" + bytes(range(55)) + b"w" * 9]
    part, offset, lcp, left = suffix_dedup.suffix_array(parts)
    found = suffix_dedup.intervals(lcp, np.array([5, 6, 7])[part], left)
    groups = {(length, tuple(sorted((int(part[i]), int(offset[i])) for i in range(a, b + 1)))) for a, b, length, _ in found}
    assert groups == {(60, ((0, 3), (1, 3))), (55, ((0, 3), (1, 3), (2, 1)))}


def test_lines_against_sql(spark, documents):
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    want = {r[0]: r[1:] for r in con.sql(line_dedup.OP2_SQL).fetchall()}
    out = line_dedup.dedup_lines(documents).collect()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"], r["n_removed_chunks"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in out}
    assert got == want and any(x[1] for x in got.values())


def test_line_edge_cases(spark, odd, empty):
    got = {}
    for r in line_dedup.dedup_lines(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == odd.count()
    assert got[2][0]["text"] is None and got[2][0]["n_lines"] == 0 and got[1][0]["text"] == "" and got[1][0]["n_lines"] == 1
    assert line_dedup.dedup_lines(empty).count() == 0
    rows = [(1, "a\nb\nc\nd\ne\nf\ng"), (2, "x\na\nb\nc\nd\ne\nf\ng"), (3, "a\nb\nc\nd\ne\nf\ng"), (None, "a\nb\nc\nd\ne\nf\ng")]
    out = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[None] == 0 and out[1] > 0 and out[1] == out[3]  # a null key sorts first


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8))
    x[300:310] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("node", F.lit("n"))
    out = nn_descent.nearest(df, F.col("vec_id") % 20 == 0).collect()
    hits = total = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:20]
        mine = sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in mine)
        hits, total = hits + len(set(want) & {r["vec_id"] for r in mine}), total + 20
    assert hits / total > 0.97 and {r["query_id"] for r in out} == set(range(0, 400, 20))
    few = nn_descent.nearest(df.where("vec_id < 5 or vec_id > 899"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3, 4]
    assert nn_descent.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def graph_overlap(spark, x):
    """Share of the true nearest in the neighbour graph of vectors of equal norm."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    vecs, _, width = nn_descent.nodes(df)[:3]
    graph = {r["node"]: set(r["nbrs"]) for r in nn_descent.build(vecs, width).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(nn_descent.K, len(x) - 1)
    return np.mean([len(graph[i] & set(np.argsort(-s[i])[:k].tolist())) / k for i in range(len(x))])


@pytest.mark.parametrize("dense", [False, True])
def test_rounds_finish_the_graph(spark, monkeypatch, dense):
    """Two trees of small blocks are a poor start, at any size, the more so where most vectors are alike."""
    for name, value in (("BLOCK", 40), ("TREES", 2), ("K", 10)):
        monkeypatch.setattr(nn_descent, name, value)
    x = np.random.default_rng(11).normal(size=(400, 6))
    if dense:
        x[100:] = x[0] + 0.01 * x[100:]
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert graph_overlap(spark, x) > 0.9


def test_large_blocks_are_split_by_hyperplanes(spark):
    """Halves of a block too large hold vectors that are alike, not any."""
    x = np.random.default_rng(12).normal(size=(600, 3))
    rows = [(0, 1, i, v.astype(np.float32).tobytes()) for i, v in enumerate(x)]
    out = nn_descent.split(spark.createDataFrame(rows, "tree int, code long, node long, vec binary"), 3, 50).toPandas()
    assert sorted(out["node"]) == list(range(600))
    parts = [x[g["node"]] for _, g in out.groupby("code")]
    assert max(map(len, parts)) <= 100 and sum(((p - p.mean(axis=0)) ** 2).sum() for p in parts) < 0.7 * ((x - x.mean(axis=0)) ** 2).sum()


def test_nearest_with_one_very_long_vector(spark):
    x = np.random.default_rng(13).normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 1e5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 1200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(np.argsort(-s)[:20].tolist())
        hits += len(want & got[q])
        assert (7 in want) == (7 in got[q])
    assert hits / (60 * 20) > 0.95


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in root.items() if k not in loops}


def test_few_shared_passages_make_no_pairs(spark, monkeypatch):
    """Texts that share a passage too short for a link meet in some signatures, but in fewer than linked ones would."""
    rng = random.Random(11)
    rows, passage = [], [f"p{i}" for i in range(50)]
    for i in range(40):
        rows.append((i, " ".join([*(f"a{i}x{j}" for j in range(80)), *passage, *(f"b{i}x{j}" for j in range(80))])))
    base = [f"c{j}" for j in range(200)]
    for i in range(40, 44):
        rows.append((i, " ".join(w if rng.random() > 0.01 else f"d{i}x{j}" for j, w in enumerate(base))))
    asked, possible = [], jaccard_join.possible
    monkeypatch.setattr(jaccard_join, "possible", lambda pairs, sets: asked.append({(r["a"], r["b"]) for r in pairs.collect()}) or possible(pairs, sets))
    want = linked_groups(shingle_sets(rows))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and want[43] == 40
    assert all(a >= 40 for a, _ in asked[0])


def test_pairs_of_a_family_grow_with_its_members(spark, monkeypatch):
    """Families of 15 and 45 linked texts, whose signatures few enough share that all members could be paired."""
    kept, before = {}, jaccard_join.written

    def written(df, label):
        out = before(df, label)
        if label in ("join-first", "join-pairs"):
            kept[label] = max(kept.get(label, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "written", written)
    made = []
    for k in (15, 45):
        kept.clear()
        text = [f"w{i}" for i in range(300)]
        rows = [(i, " ".join([*text[: 7 * i % 290], f"own{i}", *text[7 * i % 290 + 1 :]])) for i in range(k)]
        found = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert found == dict.fromkeys(range(k), 0)
        made.append(sum(kept.values()))
    assert made[1] <= 4 * made[0]

"""Operators that look at one text at a time."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import byte_bpe, fuzzy_hash, language_id, packing, quality, toxicity, word_bpe

P = pytest.importorskip("public_tokenizers")


def test_byte_bpe_equals_the_library(spark, odd, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    coder = byte_bpe.ranks(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.rank, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc  \n\t'sé1²日本\x1c -=.🙂") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["=" * 5000, "ab" * 2000, " " * 300 + "x"]
    assert [np.frombuffer(x, "<i4").tolist() for x in byte_bpe.encode_texts(coder, texts)] == [library.encode_ordinary(t) for t in texts]
    plain = byte_bpe.decode(byte_bpe.encode(odd, path, P.PATTERN), path, P.PATTERN).collect()
    want = {(r["doc_id"], r["text"]): r for r in odd.collect()}
    assert len(plain) == len(want) + 1
    assert sorted(bytes(r["decoded"]) for r in plain) == sorted((t or "").encode() for t in (r["text"] for r in odd.collect()))
    assert byte_bpe.decode(byte_bpe.encode(empty, path, P.PATTERN), path, P.PATTERN).count() == 0


def test_merging_one_and_many_agree():
    coder = byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    pieces = [b" the", b"tionality", b"aaaaaaaa", "ßäöü".encode(), b"xq"]
    assert [np.frombuffer(x, "<i4").tolist() for x in coder.merge(pieces)] == [coder.merge_one(p) for p in pieces]


def test_word_bpe_equals_the_library():
    coder = word_bpe.coder(P.path("word_bpe_49k.json"))
    rng = random.Random(2)
    texts = ["".join(rng.choice("abCé  \n\t'sd1²日本\x1c -=.🙂ΣİÅ½éß") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["it's we'll", "a<|endoftext|>b", "=" * 3000, ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_whole_documents(spark, odd, empty):
    path = P.path("word_bpe_49k.json")
    library = word_bpe.coder(path).library
    cut = packing.pieces(odd.select("doc_id", "text"), path, capacity=64)
    out = packing.pack(cut.withColumn("extra", F.lit(1)), ["doc_id", "piece", "start"], capacity=64, group=50).collect()
    ids = {}
    for r in out:
        assert r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        ids.setdefault((r["doc_id"], r["start"]), r["ids"])
    for d, t in {r["doc_id"]: r["text"] for r in odd.collect()}.items():
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for (k, _), part in sorted((k, v) for k, v in ids.items() if k[0] == d) for x in part] == want if d is not None else True
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in out) // 64) + 2
    assert packing.pack(packing.pieces(empty.select("doc_id", "text"), path), ["doc_id", "piece"]).count() == 0


def test_local_search_empties_bins():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randint(1, 60) for _ in range(40)]
        # next-fit leaves room that the search must use
        bins, at = [[]], 0
        for i, n in enumerate(sizes):
            if at + n > 100:
                bins.append([])
                at = 0
            bins[-1].append(i)
            at += n
        better = packing.improve([list(b) for b in bins], sizes, 100)
        assert sorted(i for b in better for i in b) == list(range(40)) and all(sum(sizes[i] for i in b) <= 100 for b in better)
        assert len(better) < len(bins)


def test_too_long_a_piece_is_an_error(spark):
    df = spark.createDataFrame([(1, 200)], "k int, length long")
    with pytest.raises(Exception, match="longer than"):
        packing.pack(df, ["k"], capacity=100).count()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y else 2)))
        row = new
    return row[-1]


def test_sign_likeness_by_brute_force():
    rng = random.Random(4)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 14))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for _ in range(200)]

    def common(a, b):
        return max([k for k in range(len(a) + 1) for i in range(len(a) - k + 1) if a[i : i + k] in b] or [0])

    want = [1 - edit(a, b) / (len(a) + len(b)) if min(len(a), len(b)) and common(a, b) >= min(5, (min(len(a), len(b)) + 1) // 2) else 0 for a, b in pairs]
    assert np.allclose(fuzzy_hash.sign_likeness(*map(list, zip(*pairs, strict=True))), want)


def test_fingerprints(spark, odd, empty):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fuzzy_hash.compare_with_edited(docs, rows=4).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    order = sorted(texts)
    for i, d in enumerate(order):
        t, u = texts[d], texts[order[(i + 1) % len(order)]]
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[d]["fingerprint"] == fuzzy_hash.fingerprint(t.encode()) and got[d]["edited_fingerprint"] == fuzzy_hash.fingerprint(e.encode())
        assert 0 <= got[d]["near_edited"] <= 1
    assert got[13]["near_next"] == 1.0 and got[1]["fingerprint"] == "3::" and got[9]["near_next"] > 0.9
    assert fuzzy_hash.compare_with_edited(empty).count() == 0
    single = fuzzy_hash.compare_with_edited(docs.where("doc_id = 0")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
    assert fuzzy_hash.compare_with_edited(odd).count() == odd.count()


def test_language(spark, documents, odd, empty):
    model = language_id.fit(documents, per_label=60)
    out = language_id.identify(documents.withColumnRenamed("lang", "known").select("doc_id", "known", "text"), model).collect()
    assert sum(r["lang_pred"] == r["known"] for r in out) / len(out) > 0.97
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert found[1] == found[2] == found[3] == found[4] == ("und", 0.0) and found[13] == found[14] and all(0 <= s <= 1 for _, s in found.values())
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_quality(spark, sf, odd, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.with_statistics(docs.select("doc_id", "text")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    model = quality.fit(rows)
    out = quality.scored(rows, model).collect()
    assert sum(r["predicted"] == r["label"] for r in out) / len(out) > 0.95 and all(0 <= r["score"] <= 1 for r in out)
    every = quality.scored(quality.with_statistics(odd), model).collect()
    assert len(every) == odd.count() and len({r["score"] for r in every if r["doc_id"] in (1, 2)}) == 1
    nothing = quality.fit(quality.with_statistics(empty).withColumn("label", F.lit(1)))
    assert {r["score"] for r in quality.scored(quality.with_statistics(odd), nothing).collect()} == {0.5}


def test_isotonic():
    assert quality.isotonic(np.arange(4), np.array([0.0, 0.6, 0.4, 1.0]), np.ones(4)).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_toxicity(spark, odd, empty):
    rng = random.Random(5)
    words = [f"wort{i}" for i in range(300)]
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join([rng.choice(words) for _ in range(30)] + (["schuft"] if bad else [])), int(bad), int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, first int, second int")
    chain = toxicity.fit(df, ("first", "second"))
    out = toxicity.score(df, chain).collect()
    assert all(r["is_first"] == (r["first"] == 1) for r in out) and len(chain.models[1][0]) == 1
    assert toxicity.score(odd, chain).count() == odd.count()
    none = toxicity.fit(df.limit(0), ("first", "second"))
    assert {r["p_first"] for r in toxicity.score(odd, none).collect()} == {0.0}


def test_packing_of_hard_lengths(spark):
    """20,000 pieces of which two or three fit, with ids over 2^53 beside a null one; and lengths for which the bound is near."""

    rng = random.Random(1)
    big = 2**60
    rows = [(big + i, rng.randint(1100, 1899)) for i in range(20_000)] + [(None, 1500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), ["doc_id"])
    made = got.collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in made) == sorted((k or 0, n) for k, n in rows)
    bins = {}
    for r in made:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= 8_100  # groups of 20,000 gave 8,326
    rows = [(i, min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1)) for i in range(20_000)]
    n = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), ["doc_id"]).select("sequence_id").distinct().count()
    assert n <= 1.01 * -(-sum(x for _, x in rows) // 4096)

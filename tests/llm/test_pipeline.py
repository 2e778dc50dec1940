import hashlib

import corpus_pipeline
import pytest
from test_pairs import linked_groups, shingle_sets

from talkloom.llm import quality, word_bpe
from talkloom.llm.common import written

P = pytest.importorskip("public_tokenizers")


def lines_left(docs):
    """{id: (text, lines removed)} by the rule for chunks, in plain Python."""
    seen, out = set(), {}
    for d, text in sorted(docs.items()):
        lines = text.split("\n")
        h = [0, 0, *(int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines)]
        chunks, now = [], []
        for i, x in enumerate(lines):
            now.append(x)
            if (h[i + 2] + 31 * h[i + 1] + 961 * h[i]) % 1000003 % 3 == 0 or i + 1 == len(lines):
                chunks.append("\n".join(now))
                now = []
        kept = [c for c in chunks if "\n" not in c or not (c in seen or seen.add(c))]
        out[d] = ("\n".join(kept), len(kept) < len(chunks))
    return out


def passages_left(docs):
    """The same for 50-byte strings that an earlier document holds."""
    first, out = {}, {}
    for d, text in sorted(docs.items()):
        b = text.encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) != d:
                cover[i : i + 50] = b"\1" * 50
        out[d] = (bytes(x for x, c in zip(b, cover, strict=True) if not c).decode("utf-8", "ignore"), any(cover))
    return out


def not_emptied(left):
    return {d: t for d, (t, cut) in left.items() if not (cut and t.strip(" ") == "")}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_pipeline_by_brute_force(spark, sf, documents):
    """Each stage after the model's, and run() as a whole, against plain Python over all documents."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r["doc_id"] for r in quality.judged(documents, labels).where("predicted = 0").collect()}
    want = {d: t or "" for d, t in texts(documents).items() if d not in bad}
    docs = written(corpus_pipeline.keep_quality(spark, documents, sf), "brute-0")
    assert {d: t or "" for d, t in texts(docs).items()} == want and bad

    want = not_emptied(lines_left(want))
    docs = written(corpus_pipeline.drop_repeated_lines(spark, docs, sf), "brute-1")
    assert texts(docs) == want

    groups = linked_groups(shingle_sets(want.items()))
    fewer = {d: t for d, t in want.items() if groups[d] == d}
    docs = written(corpus_pipeline.drop_near_duplicates(spark, docs, sf), "brute-2")
    assert texts(docs) == fewer and len(fewer) < len(want)

    want = not_emptied(passages_left(fewer))
    docs = written(corpus_pipeline.drop_repeated_passages(spark, docs, sf), "brute-3")
    assert texts(docs) == want and want != fewer

    library = word_bpe.coder(P.path("word_bpe_49k.json")).library
    sizes = {d: len(library.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    packed, bins, total = corpus_pipeline.run(spark, sf).collect(), {}, {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == sizes
    for b in bins.values():
        ends = [o + n for o, n in sorted(b)]
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(bins) <= -(-sum(sizes.values()) // 4096) + 1


def test_stages_keep_the_columns_and_drop_what_they_should(spark, sf, documents):
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == documents.columns
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert 0 < sizes[-1] <= sizes[0] < documents.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = corpus_pipeline.keep_quality(spark, documents, sf)
    assert first.join(labels.where("quality = 1"), "doc_id").count() == documents.join(labels.where("quality = 1"), "doc_id").count()


def test_odd_rows_pass(spark, sf, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), "test-odd")
    assert docs.count() > 0

"""Sentences by pieces, joins by overlap and lexicons as tables against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.functions import extract, text
from talkloom.functions.lexicons import RUSSIAN, Pack
from talkloom.operators import overlap, pieces

BITS = ["а", "Б", "г.", "т.е.", "руб.", "А.", "слово", "Слово", ".", "..", "!?", "…", " ", "  ", "\n", "\n\n", "»", "\"", ")", "]", "«", "(", "-", "3.14", "5", "x́", "\U0001F600", "и т.д.", " ", "\x01"]


def as_set(df):
    return {(r["doc_id"], r["sent_idx"], r["sentence"]) for r in df.collect()}


@pytest.mark.parametrize("seed, piece", [(1, 24), (2, 31), (3, 60), (4, 200)])
def test_pieces_give_the_sentences_of_whole_texts(spark, seed, piece):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += ["", None, " \n", "." * 300, "а" * 300, " " * 300 + "Б", "г. " * 100, "а.\n\n" * 100, "😀" * 100, texts[0], "Да. " * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("sentence", F.lit("other"))
    got = pieces.long_text_sentences(docs, piece=piece)
    assert got.columns == ["doc_id", "sent_idx", "sentence"]
    rows = as_set(got)
    assert rows == as_set(text.sentences(docs)) and len(rows) == got.count()


def test_pieces_make_up_the_text_and_are_many(spark):
    long = "Слово за словом. " * 4000
    docs = spark.createDataFrame([(7, long)], "doc_id long, text string")
    rows = sorted(pieces.piece_rows(docs, "doc_id", "text", RUSSIAN, 1000).collect(), key=lambda r: r["piece"])
    assert "".join(r["body"] for r in rows) == long and max(len(r["body"]) for r in rows) < 1010 and len(rows) > 60
    assert all(r["body"][-1].isalnum() for r in rows[:-1])
    with pytest.raises(ValueError):
        pieces.long_text_sentences(docs, piece=5)
    assert pieces.long_text_sentences(docs.limit(0)).count() == 0
    assert as_set(pieces.long_text_sentences(docs, pack=Pack(**{**RUSSIAN.__dict__, "abbreviations": ()}), piece=50)) == {(7, i, "Слово за словом.") for i in range(4000)}


def pairs(left, right):
    ok = lambda r: None not in r[:3] and r[2] > r[1]
    return sorted((a[3], b[3], min(a[2], b[2]) - max(a[1], b[1])) for a in left for b in right if ok(a) and ok(b) and a[0] == b[0] and min(a[2], b[2]) > max(a[1], b[1]))


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 4), (3, 10)])
def test_overlaps_equal_all_pairs(spark, seed, least):
    rng = random.Random(seed)

    def side(n):
        out = []
        for i in range(n):
            at, long = rng.randrange(-3000, 3000), rng.choice([0, 1, 1, 2, 7, 40, 300, 2500, -5])
            out.append((rng.choice(["hot"] * 6 + ["a", None]), None if rng.random() < 0.02 else at, at + long, i))
        return out

    left, right = side(300), side(250) + [("hot", -(1 << 40), 1 << 40, 250), ("hot", 5, 6, 251), ("hot", 5, 6, 252)]
    frame = lambda rows: spark.createDataFrame(rows, "key string, start_ms long, end_ms long, id int")
    got = overlap.overlapping(frame(left), frame(right), ["key"], least=least)
    assert sorted((r["id"], r["other"]["id"], r["overlap"]) for r in got.collect()) == pairs(left, right)
    assert overlap.overlapping(frame(left), frame(right).limit(0), ["key"]).count() == 0
    assert overlap.overlapping(frame(left).limit(0), frame(right), ["key"]).count() == 0


def test_a_hot_key_is_spread_and_long_rows_are_copied_little(spark):
    short = spark.range(20000).select(F.lit(1).alias("key"), (F.col("id") * 500).alias("start_ms"), (F.col("id") * 500 + 400).alias("end_ms"))
    long = spark.createDataFrame([(1, 0, 10_000_000)] * 3, "key int, start_ms long, end_ms long")
    assert overlap.overlapping(short, long, ["key"]).count() == 60000


def test_speakers_by_time(spark):
    words = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 200), (1, 2, 900, 950), (2, 0, 0, 10), (None, 0, 0, 10), (1, 3, 300, 300)], "s int, w int, start_ms long, end_ms long")
    spans = spark.createDataFrame([(1, 0, 40, 5), (1, 60, 100, 5), (1, 30, 100, 3), (1, 100, 150, 4), (1, 150, 200, 2), (1, 0, 999, None), (None, 0, 99, 8)], "s int, start_ms long, end_ms long, speaker_id int")
    got = {(r["s"], r["w"]): r["speaker_id"] for r in overlap.speakers_by_time(words, spans, ["s"], ["w"], default=0).collect()}
    assert got == {(1, 0): 5, (1, 1): 2, (1, 2): 0, (2, 0): 0, (None, 0): 0, (1, 3): 0}  # 80 ms against 70; a tie to the smaller id


def test_both_forms_of_lexicons_agree(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    texts = spark.createDataFrame([(i, rng.choice([None, "", word(40).upper(), word(9)])) for i in range(80)], "id int, text string")
    words = spark.createDataFrame([(word(rng.randrange(0, 7)),) for _ in range(60)] + [(None,)], "word string")
    rows = [sorted((r["id"], r["word"]) for r in extract.contained_in(texts, "text", words, most=most).collect()) for most in (1000, 3)]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    assert extract.contained_in(texts, "text", words.limit(0)).count() == 0


def test_a_long_text(spark):
    """Equal by count, length and hash; the whole-text form is the twin."""
    unit = "В 2024 г. Иванов А. Б. сказал «Да.» Потом было 3.14 руб. и т.д. Вот так!\n\nНовый абзац… "
    doc = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit(unit), (F.col("id") + 30_000_000 // len(unit.encode())).cast("int")).alias("text"))
    sums = lambda df: df.agg(F.count("*"), F.sum(F.length("sentence")), F.sum(F.xxhash64("sent_idx", "sentence").cast("decimal(38,0)"))).first()
    got = sums(pieces.long_text_sentences(doc))
    assert got == sums(text.sentences(doc)) and got[0] > 600_000


def test_large_lexicons_are_looked_up_in_parts(spark, monkeypatch):
    """No text is copied for a lexicon of over 100,000 words, and parts of any size find the same."""
    texts = spark.createDataFrame([(1, "xx w100001 w7"), (2, ""), (3, None), (4, "ww50000w")], "id int, text string")
    words = spark.range(100_002).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    want = [(1, "w1"), (1, "w10"), (1, "w100"), (1, "w1000"), (1, "w10000"), (1, "w100001"), (1, "w7"), (4, "w5"), (4, "w50"), (4, "w500"), (4, "w5000"), (4, "w50000")]
    for part in (500_000, 40_000):
        monkeypatch.setattr(extract, "PART_WORDS", part)
        found = extract.contained_in(texts, "text", words)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["id"], r["word"]) for r in found.collect()) == want


def test_few_levels(spark):
    """A row is copied for each level of the other side, so lengths of 1 to 2^30 ms must not make thirty of them."""
    rows = spark.range(31).selectExpr("0 AS key", "0L AS start_ms", "shiftleft(1L, cast(id AS int)) AS end_ms")
    levels = [r[0] for r in rows.select(overlap._level("start_ms", "end_ms", overlap.LEAST)).collect()]
    assert spark.sql("SELECT 0L AS a, shiftleft(1L, 62) + 1 AS b").select(overlap._level("a", "b", overlap.LEAST)).first()[0] == 63
    assert len(set(levels)) <= 8 and all(2**x >= 2**i for i, x in enumerate(levels))

"""Session streams, report files, and the choice between ranking in a task and by joins."""

import json

from pyspark.sql import functions as F

from talkloom.functions import extract
from talkloom.operators import rank
from talkloom.sources import sessions as src


def record(i, words=2):
    return {"id": f"s{i}", "createdAt": i, "audioFileName": " ", "metadata": {"title": f"T{i}"}, "participants": {"0": "Ann"},
            "transcript": {"totalDurationMs": 900, "segments": [{"speakerId": 0, "startMs": 0, "endMs": 900, "words": [{"text": "a", "startMs": 0, "endMs": 9, "confidence": 0.9}] * words}]}}


def test_session_stream_reads_new_files_and_skips_bad_ones(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "session_1.json").write_text(json.dumps(record(1), indent=1))
    (folder / "session_2.json").write_text("{broken")
    (folder / "notes.json").write_text(json.dumps(record(9)))
    query = src.session_stream(spark, str(folder)).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.start().awaitTermination()
    assert [r["id"] for r in spark.table("streamed").collect()] == ["s1"]
    (folder / "session_3.json").write_text(json.dumps(record(3)))
    src.session_stream(spark, str(folder)).writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "out")).collect()) == ["s1", "s3"]


def test_reports_are_files_by_name(spark, tmp_path):
    out = str(tmp_path / "reports")
    src.write_reports(spark.createDataFrame([("a", "one\ntwo"), ("b", "")], "name string, body string"), out)
    got = {r["name"]: r["body"] for r in spark.read.text(out, wholetext=True).select("name", F.col("value").alias("body")).collect()}
    assert got["a"] == "one\ntwo\n" and set(got) == {"a", "b"}


def test_large_documents_are_ranked_by_joins_alike(spark):
    sents = spark.createDataFrame([(d, i, " ".join(f"wort{(i * k + d) % 7}" for k in range(1, 9))) for d in (1, 2) for i in range(9 if d == 1 else 4)] + [(3, 0, "alone here")],
                                  "doc_id long, sent_idx int, sentence string")
    s = rank.RankSettings()
    want = {(r[0], r[1]): r[2] for r in rank.base_scores(sents, s=s).collect()}
    for most in (5, 0, None):
        got = {(r[0], r[1]): r[2] for r in rank.base_scores(sents, s=s, most=most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    old = rank.page_rank(rank.similarity(rank.tf_idf(sents, s=s), threshold=s.threshold), sents, s=s)
    assert all(abs(want[r[0], r[1]] - r[2]) < 1e-9 for r in old.collect())


def test_words_of_a_table_are_found_in_texts(spark):
    texts = spark.createDataFrame([(1, "Großer ABend ab"), (2, ""), (3, None), (4, "xabendy")], "id int, text string")
    words = spark.createDataFrame([("abend",), ("ab",), ("zz",), ("",), ("abend",)], "word string")
    got = sorted((r["id"], r["word"]) for r in extract.contained_in(texts, "text", words).collect())
    assert got == [(1, "ab"), (1, "abend"), (4, "ab"), (4, "abend")]

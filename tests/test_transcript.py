import json

import pytest
from pyspark.sql import functions as F

from talkloom.operators import entities, intervals, inventory, report, transcript, vectors
from talkloom.sources import files, sessions


def segs(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "session_id string, seg_idx int, speaker_id int, start_ms long, end_ms long, text string")


def test_merging(spark):
    df = segs(spark, [(0, 0, 100, "a"), (0, 100, 200, "b"), (0, 2200, 2300, "c"), (0, 4301, 4400, "d"), (0, 4399, 4500, "e"), (1, 4500, 4600, "f"), (1, 4600, 4700, "g")])
    got = [(r["speaker_id"], r["start_ms"], r["end_ms"], r["text"]) for r in transcript.merged_turns(df).orderBy("turn").collect()]
    assert got == [(0, 0, 2300, "a b c"), (0, 4301, 4400, "d"), (0, 4399, 4500, "e"), (1, 4500, 4700, "f g")]
    assert " ".join(x[3] for x in got) == "a b c d e f g"


def test_confidence(spark):
    df = spark.createDataFrame([(0.85,), (0.65,), (0.6499,)], "c float")
    assert [r[0] for r in df.select(transcript.confidence_level(F.col("c"))).collect()] == ["HIGH", "MEDIUM", "LOW"]
    w = spark.createDataFrame([(x,) for x in ("a", "ab", "abc", "abcd", "abcde")], "w string").select(transcript.proxy_confidence(F.col("w")))
    assert [round(r[0], 2) for r in w.collect()] == [0.45, 0.65, 0.78, 0.78, 0.92]


def test_even_words(spark):
    got = transcript.even_words(segs(spark, [(0, 10, 110, "a b c")]), ["session_id", "seg_idx"]).orderBy("word_idx").collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(10, 43), (43, 76), (76, 109)]


def test_stats_without_words(spark):
    s = segs(spark, [(2, 0, 10, ""), (0, 10, 20, "ab")])
    w = transcript.even_words(s, ["session_id", "seg_idx"])
    assert {(r["seg_idx"], round(r["min_confidence"], 2)) for r in transcript.segment_confidence(w, s, ["session_id", "seg_idx"]).collect()} == {(0, 1.0), (1, 0.65)}
    r = transcript.transcript_stats(w, s).first()
    assert (r["n_segments"], r["n_words"], r["n_medium"], r["speakers"]) == (2, 1, 1, [0, 2])


def test_useful_segments(spark):
    df = spark.createDataFrame([(0, 199, ["a"]), (0, 200, ["a"]), (10, 5, ["a"]), (0, 500, [])], "start_ms long, end_ms long, words array<string>")
    assert transcript.useful_segments(df).count() == 1


def test_stitching(spark):
    df = spark.createDataFrame([("s", 0, 0, 0, 0, 5), ("s", 0, 1, 2, 5, 9), ("s", 1, 0, 0, 0, 4)], "session_id string, chunk_idx int, seg_idx int, speaker_id int, start_ms long, end_ms long")
    chunks = spark.createDataFrame([("s", 0, 0), ("s", 1, 100), ("s", 2, 200)], "session_id string, chunk_idx int, chunk_start_ms long")
    plain = {(r["chunk_idx"], r["seg_idx"]): (r["speaker_id"], r["start_ms"]) for r in transcript.stitched_chunks(df, chunks).collect()}
    assert plain == {(0, 0): (0, 0), (0, 1): (2, 5), (1, 0): (2, 100)}  # ids {0, 2} collide with the shifted one
    dense = {r["speaker_id"] for r in transcript.stitched_chunks(df, chunks, dense=True).collect()}
    assert dense == {0, 1, 2}


def test_labels_defaults_and_flags(spark):
    names = spark.createDataFrame([("s", 0, " Анна "), ("s", 1, " ")], "session_id string, speaker_id int, name string")
    got = [r["speaker"] for r in transcript.speaker_labels(segs(spark, [(0, 0, 1, ""), (1, 1, 2, ""), (2, 2, 3, "")]), names).orderBy("seg_idx").collect()]
    assert got == ["Анна", "Спикер 2", "Спикер 3"]
    a = spark.createDataFrame([([2, 0], [1]), ([], [])], "a array<int>, b array<int>").select(transcript.all_speakers(F.col("a"), F.col("b")))
    assert [r[0] for r in a.collect()] == [[0, 1, 2], [0]]
    rec = spark.createDataFrame([("a", 70), ("b", 80)], "session_id string, duration_ms long")
    iv = spark.createDataFrame([("a", 1, 5, 6)], "session_id string, speaker_id int, start_ms long, end_ms long")
    assert {tuple(r) for r in transcript.with_default_interval(rec, iv).collect()} == {("a", 1, 5, 6), ("b", 0, 0, 80)}
    inv = spark.createDataFrame([("x.wav", 10), ("y.wav", 0)], "filename string, length long")
    s = spark.createDataFrame([("x.wav",), ("y.wav",), (None,)], "audioFileName string")
    assert {tuple(r) for r in transcript.audio_flag(s, inv).collect()} == {("x.wav", True), ("y.wav", False), (None, False)}


def word(t="да"):
    return {"text": t, "startMs": 0, "endMs": 5, "confidence": 0.9}


def session(i, **more):
    return {"id": i, "createdAt": 5, "metadata": {"title": "T"}, "participants": {"0": "Анна", "x": "?", "1": " "},
            "transcript": {"totalDurationMs": 9, "segments": [{"speakerId": 0, "startMs": 0, "endMs": 5, "words": [word(), word("нет")]}, {"speakerId": 1, "startMs": 5, "endMs": 6, "words": []}]}} | more


def test_session_files(spark, tmp_path):
    (tmp_path / "session_a.json").write_text(json.dumps(session("a")))
    (tmp_path / "session_b.json").write_text(json.dumps(session("b", createdAt=7, audioFileName=" ")))
    (tmp_path / "session_c.json").write_text(json.dumps(session("c"))[:-30])
    (tmp_path / "session_d.json").write_text(json.dumps({"id": "d", "metadata": {}}))
    (tmp_path / "other.json").write_text(json.dumps(session("e")))
    got = sessions.read_sessions(spark, str(tmp_path))
    assert [r["id"] for r in sessions.history(got).collect()] == ["b", "a"]
    assert sessions.history(got).first()["n_words"] == 2
    assert sessions.load(spark, str(tmp_path), "a").count() == 1 and sessions.load(spark, str(tmp_path), "c").count() == 0
    assert [(r["speaker_id"], r["name"]) for r in transcript.participants_of(got.where("id = 'a'")).collect()] == [(0, "Анна")]
    assert transcript.words_of(transcript.segments_of(got)).count() == 4
    assert sessions.without(got, spark.createDataFrame([("a",)], "id string")).count() == 1
    new = got.where("id = 'a'").withColumn("createdAt", F.lit(99).cast("long"))
    assert sessions.upserted(got, new).agg(F.max("createdAt")).first()[0] == 99
    out = str(tmp_path / "out")
    sessions.write_sessions(got, out)
    sessions.write_sessions(new, out)
    again = {r["id"]: r["createdAt"] for r in sessions.read_written(spark, out).collect()}
    assert again == {"a": 99, "b": 7}


def test_recordings_and_manifest(spark, tmp_path):
    head = bytearray(44)
    head[22:24], head[24:28] = (2).to_bytes(2, "little"), (16000).to_bytes(4, "little")
    (tmp_path / "a.wav").write_bytes(bytes(head) + bytes(16000 * 4 * 2))
    (tmp_path / "b.wav").write_bytes(b"short")
    binary = sessions.files(spark, str(tmp_path), "*.wav")
    r = sessions.recordings(binary).collect()
    assert len(r) == 1 and (r[0]["sample_rate"], r[0]["channels"], r[0]["duration_ms"]) == (16000, 2, 2000)
    found = files.manifest(spark, str(tmp_path), "*.wav")
    sha = {x["filename"]: x["sha256"] for x in found.collect()}
    rows = [("1", "a.wav", 128044, sha["a.wav"], "t"), ("2", "b.wav", 5, "0" * 64, "t"), ("3", "b.wav", 6, sha["b.wav"], "u"), ("4", "c.wav", 1, "", "u"), ("5", "b.wav", 5, "PLACEHOLDER_x", "v")]
    manifest = spark.createDataFrame(rows, "id string, filename string, size_bytes long, sha256 string, tier string")
    status = {x["id"]: x["status"] for x in inventory.checked(manifest, found).collect()}
    assert status == {"1": "valid", "2": "hash", "3": "size", "4": "missing", "5": "valid"}
    assert {x["id"] for x in inventory.pending(manifest, found).collect()} == {"2", "3", "4"}
    assert {x["tier"]: x["all_valid"] for x in inventory.totals(inventory.checked(manifest, found)).collect()} == {"t": False, "u": False, "v": True}


def test_tags(spark):
    tags = [("B-PER", "I-PER", "I-PER"), ("B-PER", "I-ORG", "O"), ("I-PER", "O", "B-LOC"), ("B-PER", "B-PER", "I-PER")]
    rows = [(d, i, f"w{i}", t) for d, ts in enumerate(tags) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id int, tok_idx int, token string, tag string")
    got = {(r["doc_id"], r["type"], r["text"]) for r in entities.spans(df, ["doc_id"]).collect()}
    assert got == {(0, "PER", "w0 w1 w2"), (1, "PER", "w0"), (2, "LOC", "w2"), (3, "PER", "w0"), (3, "PER", "w1 w2")}


@pytest.mark.parametrize("text, kind, junk", [("угу", "PER", True), ("э-э-э", "PER", True), ("бла-бла", "ORG", True), ("Ия", "PER", True), ("Лев", "PER", True), ("Лев", "ORG", False), ("Паша", "PER", True), (" ", "PER", True), ("Мария Ивановна", "PER", False)])
def test_junk(spark, text, kind, junk):
    assert spark.createDataFrame([(text, kind)], "t string, k string").select(entities.is_junk(F.col("t"), F.col("k"))).first()[0] is junk


def test_entity_counts_and_tokens(spark):
    df = spark.createDataFrame([(1, "PER", "Анна Петрова"), (1, "PER", "Анна Петрова"), (1, "LOC", "Москва")], "doc_id int, type string, text string")
    n = entities.entity_counts(df)
    assert {(r["type"], r["count"], r["rank"]) for r in n.collect()} == {("PER", 2, 1), ("LOC", 1, 1)}
    assert entities.entity_tokens(n).first()["tokens"] == ["анна", "анна петрова", "москва", "петрова"]


def test_intervals(spark):
    rec = spark.createDataFrame([("a", 1_800_000), ("b", 1_800_001)], "k string, duration_ms long")
    assert [r["k"] for r in intervals.too_long(rec).collect()] == ["b"]
    assert [(r["start_ms"], r["end_ms"]) for r in intervals.fixed_chunks(rec.where("k = 'b'"), ["k"]).orderBy("chunk_idx").collect()] == [(0, 1_800_000), (1_800_000, 1_800_001)]
    r = spark.createDataFrame([("x", 45_000), ("y", 45_001), ("z", 89_500)], "k string, duration_ms long")
    n = {x["k"]: x["count"] for x in intervals.overlapping_chunks(r, ["k"]).groupBy("k").count().collect()}
    assert n == {"x": 1, "y": 2, "z": 2}
    iv = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.4, 2.0), ("a", 2.5, 2.7), ("a", 9.0, 9.2)], "k string, start_s double, end_s double")
    assert [(x["start_s"], x["end_s"]) for x in intervals.merged_intervals(iv, ["k"]).orderBy("run").collect()] == [(0.0, 2.0)]
    f = spark.createDataFrame([(1, -3), (1, -4), (2, 40000), (2, 40000)], "frame int, value int")
    assert {x["frame"]: x["value"] for x in intervals.downmixed(f, ["frame"]).collect()} == {1: -3, 2: 32767}


def test_resampling_and_levels(spark):
    rows = [("a", "2024-01-01 00:00:00", 0.0), ("a", "2024-01-01 00:00:04", 4.0), ("a", "2024-01-01 00:00:05", 5.0), ("b", "2024-01-01 00:00:00", 7.0)]
    df = spark.createDataFrame(rows, "key string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r["key"], r["value"]) for r in intervals.resampled(df, "key", "2 seconds").orderBy("key", "ts").collect()]
    assert got == [("a", 0.0), ("a", 2.0), ("a", 4.0), ("a", 5.0), ("b", 7.0)] or got == [("a", 0.0), ("a", 2.0), ("a", 4.0), ("b", 7.0)]
    level = intervals.rms_level(df, "key", "1 minute")
    assert {r["key"]: r["level"] for r in level.collect()} == {"a": 1.0, "b": 1.0}


def test_vectors(spark):
    book = spark.createDataFrame([(s, c, [float(c), float(s)]) for s in range(2) for c in range(3)], "sub int, code int, chunk array<double>")
    codes = spark.createDataFrame([("w", [2, 0])], "word string, codes array<int>")
    vec = vectors.decoded(codes, book)
    assert vec.first()["vec"] == [2.0, 0.0, 0.0, 1.0]
    back = vectors.encoded(vec.withColumnRenamed("vec", "v"), book, "word", "v", 2).first()["codes"]
    assert back == [2, 0]
    words = spark.createDataFrame([("W",), ("нет",)], "word string")
    got = {r["word"]: r["vec"] for r in vectors.lookup(words, vec, unknown=[0.0]).collect()}
    assert got == {"W": [2.0, 0.0, 0.0, 1.0], "нет": [0.0]}


def test_reports(spark):
    long = "Мария Ивановна сказала что нарушение правил на заводе стоит 20% бюджета сегодня. Потом Мария Ивановна сказала что нарушение правил на заводе не повторится. Нет."
    docs = spark.createDataFrame([(1, long), (2, ""), (3, None)], "doc_id long, text string")
    tagger = lambda t: entities.shape_run_tagger(t, ["doc_id", "sent_idx"])
    s = report.summaries(docs, tagger=tagger)
    rows = {r["doc_id"]: r for r in s.collect()}
    assert rows[1]["n_sentences"] == 3 and len(rows[1]["quotes"]) == 2 and rows[1]["risks"][0]["triggers"] == ["нарушени", "наруш"]
    assert rows[2]["quotes"] == [] and rows[3]["numbers"] == [] and rows[3]["entities"] == []
    md = {r["doc_id"]: r["markdown"] for r in report.markdown(s).collect()}
    assert "Найдено 2 предложений" in md[1] and "Числовые значения не найдены." in md[2] and md[2].startswith("# Резюме интервью")
    plain = {r["doc_id"]: r["body"] for r in report.plain_text(s, title=F.lit("Тест"), made_ms=F.lit(0).cast("long")).collect()}
    assert "Тема: Тест" in plain[1] and "КЛЮЧЕВЫЕ ЦИТАТЫ" in plain[1] and "КЛЮЧЕВЫЕ ЦИТАТЫ" not in plain[2]
    p = report.prompts(s).where("doc_id = 1").collect()
    assert {(r["section_id"], r["max_tokens"]) for r in p} == {("topic", 300), ("participants", 500), ("topics", 600), ("risks", 600), ("numbers", 600)}
    answers = spark.createDataFrame([(1, "topic", "О заводе"), (1, "risks", "Есть")], "doc_id long, section_id string, answer string")
    assert "ТЕМА: О заводе" in report.conclusion_prompts(answers).first()["user_message"]
    both = {r["doc_id"]: r for r in report.merged_answers(report.markdown(s), answers).collect()}
    assert "О заводе" in both[1]["markdown"] and report.MISSING in both[1]["markdown"] and both[2]["sections"] == {}


def test_protocol(spark):
    df = segs(spark, [(0, 0, 100, "a"), (1, 3_600_000, 3_600_100, "b <c>")])
    none = spark.createDataFrame([], "session_id string, speaker_id int, name string")
    got = [(r["time"], r["speaker"], r["utterance"]) for r in report.protocol_table(df, none).orderBy("turn").collect()]
    assert got == [("00:00:00", "Спикер 1", "a"), ("01:00:00", "Спикер 2", "b <c>")]
    w = transcript.even_words(df, ["session_id", "seg_idx"])
    html = report.colored_utterances(w, ["session_id", "seg_idx"], transcript.confidence_level(F.col("confidence"))).where("seg_idx = 1").first()["html"]
    assert "&lt;c&gt;" in html and "C62828" in html


def test_sessions_are_written_by_tasks_a_file_each(spark, tmp_path):
    """A write by partitions would leave checksums and other names, and move each folder in the driver."""
    out = str(tmp_path / "store")
    lines = [f'{{"id": "{x}", "createdAt": {i}, "metadata": {{"title": "t"}}, "participants": {{}}, "transcript": {{"totalDurationMs": 1, "segments": []}}}}' for i, x in enumerate(["a", "b/c", "a"])]
    rows = spark.read.schema(sessions.SESSION).json(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r[0]))
    made = sessions.valid(rows)
    sessions.write_sessions(made, out)
    assert sorted((r["id"], r["createdAt"]) for r in sessions.read_written(spark, out).collect()) == [("a", 0), ("a", 2), ("b/c", 1)]
    sessions.write_sessions(made.where("createdAt = 2"), out)
    assert sorted((r["id"], r["createdAt"]) for r in sessions.read_written(spark, out).collect()) == [("a", 2), ("b/c", 1)]
    assert sorted(str(p.relative_to(out)) for p in (tmp_path / "store").rglob("*") if p.is_file()) == ["session=a/part-0.json", "session=b%2Fc/part-0.json"]

"""Summaries made in the row: the same as by a tagger and joins, without a shuffle."""
from pyspark.sql import functions as F

from talkloom.functions.lexicons import TEST
from talkloom.functions.text import counted, shape
from talkloom.operators import entities as ent
from talkloom.operators import rank, report

ODD = ["", "a", "Ab", "AB", "Abc", "aBc", "A-B", "Ab-Cd", "Ab-cd", "A", "7", "A7b", "7Ab", "Ab_c", "_Ab", "Иван", "ИВан", "Аб-Вг", "Ελλάς", "Éa", "Ünd", "ß", "Ǆa", "ªAb", "Ab\n", "A-B\n", "ы҈Ab", "...", "-", None]
TEXTS = ["Then Anna Berg met Karl Voss and Anna Berg in the old town today. Nobody saw Karl Voss leave the old town in the evening.", "", None, "one two three",
         "We saw Иван Петров and then, Maria\x01Lopez went to the mill of the old town again. It was the old town and the mill that Maria liked so much in 7 days."]


def test_names_by_pattern_are_those_by_shape(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for r in df.select("t", ent.is_name(F.col("t")).alias("a"), shape(F.col("t")).rlike("_(Xx|Xx-Xx)$").alias("b")).collect():
        assert r["a"] == r["b"], r


def test_runs_of_a_sentence_are_the_taggers_spans(spark):
    sents = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + ["Ab Cd, Ef Gh. Ij-Kl Mn x Op", "x Ab_c Иван-Ольга ...Ab"])], "doc_id int, sentence string").withColumn("sent_idx", F.lit(0))
    keys = ["doc_id", "sent_idx"]
    want = ent.spans(ent.shape_run_tagger(ent.tokens_of(sents, keys), keys), keys).select("doc_id", "type", "text").collect()
    got = ent.shape_run_spans(sents).collect()
    assert sorted(got) == sorted(want) and len(want) > 6


def test_items_are_counted_in_order(spark):
    lists = [["b", "a", "b", "é", "z"], [], None, ["a", "a", "c", "b", "c"], ["z"]]
    got = spark.createDataFrame(list(enumerate(lists)), "i int, l array<string>").coalesce(1).select("i", counted(F.col("l")).alias("c")).orderBy("i").collect()
    assert [[tuple(x) for x in r["c"]] for r in got] == [[(-2, "b"), (-1, "a"), (-1, "z"), (-1, "é")], [], [], [(-2, "a"), (-2, "c"), (-1, "b")], [(-1, "z")]]


def test_summary_is_made_without_a_shuffle(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    s = report.SummarySettings(pack=TEST, rank=rank.RankSettings(pack=TEST), digits=6)
    made = report.summaries(docs, s=s, names=ent.shape_runs)
    old = report.summaries(docs, s=s, tagger=lambda t: ent.shape_run_tagger(t, ["doc_id", "sent_idx"]))
    assert sorted(made.collect()) == sorted(old.collect()) and made.where("size(entities) > 1").count() == 2
    asked = report.prompts(made)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and asked.count() == 5 * len(TEXTS)


def test_lists_are_ranked_as_by_joins(spark):
    words = [f"w{i}xx" for i in range(12)]
    sents = [(d, i, " ".join(words[(i * k + d) % 12] for k in range(1, 3 + i % 4))) for d in range(3) for i in range(9)] + [(7, 0, "alone here"), (8, 0, ""), (8, 1, "x")]
    df = spark.createDataFrame(sents, "doc_id int, sent_idx int, sentence string")
    want = {(r[0], r[1]): r[2] for r in rank.page_rank(rank.similarity(rank.tf_idf(df)), df).collect()}
    got = {(r[0], r[1]): r[2] for r in rank.base_scores(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_best_of_lists_are_those_of_the_table_without_a_shuffle(spark, monkeypatch):
    words = [f"w{i}xx" for i in range(12)]
    sents = [(d, 2 * i, " ".join(words[(i * k + d) % 12] for k in range(1, 3 + i * 2)) + " 7" * (i % 2)) for d in range(3) for i in range(9)] + [(7, 4, "alone here")]
    df = spark.createDataFrame(sents, "doc_id int, sent_idx int, sentence string")
    rows = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))).alias("items")).unionByName(spark.sql("SELECT 9 AS doc_id, cast(array() AS array<struct<sent_idx:int,sentence:string>>) AS items"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    columns = ["doc_id", "sent_idx", "sentence", "base", "boosted", "rank"]
    want = rank.top_k(rank.lex_rank(df).withColumn("base", F.round("base", 6)).withColumn("boosted", F.round("boosted", 6)), 5).select(columns)
    got = rank.best_of_lists(rows, 5, "items").select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    only = rank.RankSettings(max_iterations=300, tolerance=1e-9)
    large = rank.ranked_lists(rows, "items", s=only, most=4).collect()
    few = {r["doc_id"]: r["base"] for r in rank.ranked_lists(rows, "items", s=only).collect()}
    assert all(len(few[r["doc_id"]]) == len(r["base"]) and all(abs(x - y) < 1e-6 for x, y in zip(few[r["doc_id"]], r["base"])) for r in large)

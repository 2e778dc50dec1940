import pytest
from pyspark.sql import functions as F

from talkloom.functions import extract, formats, text
from talkloom.functions.lexicons import RUSSIAN, Pack


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [
    ("Привет. Как дела? Хорошо!", ["Привет.", "Как дела?", "Хорошо!"]),
    ("А.С. Пушкин жил в г. Москве. Да.", ["А.С.", "Пушкин жил в г. Москве.", "Да."]),
    ("А. Пушкин писал. 20 руб. Итого 3.14 и т.д. Потом", ["А. Пушкин писал.", "20 руб. Итого 3.14 и т.д. Потом"]),
    ("«Да.» Нет. (Вот.) Ok", ["«Да.", "» Нет.", "(Вот.", ") Ok"]),
    ("Что?! Нет... Может быть… да. — Ага", ["Что?!", "Нет...", "Может быть… да.", "— Ага"]),
    ("раз\n\nдва\n\n\nтри", ["раз", "два", "три"]),
    ("site.ru Ok. д-р. Иванов", ["site.ru Ok. д-р.", "Иванов"]),
    ("Т.Е. Так. т.е. Так!нет Да!Нет. 5", ["Т.Е. Так. т.е. Так!нет Да!", "Нет.", "5"]),
    ("  \n ", []), ("", []), (None, []),
])
def test_sentences(spark, given, want):
    assert one(spark, given, text.split_sentences) == want


def test_word_count_and_terms(spark):
    assert [one(spark, t, text.word_count) for t in ("", " а б ", "a b")] == [1, 4, 2]
    assert one(spark, "Это Проверка-2 ну и да, 2024 год", text.terms) == ["проверка-2", "2024", "год"]
    assert one(spark, "Проверка 2024 год потом", text.topic_words) == ["проверка"]
    assert one(spark, "Да, «тест_1»!", text.tagging_tokens) == ["Да", ",", "«", "тест_1", "»", "!"]


@pytest.mark.parametrize("token, want", [
    ("", "OTHER"), ("123", "NUM"), (",", "PUNCT_,"), ("Москва", "RU_Xx"), ("США", "RU_XX"), ("Я", "RU_X"), ("да", "RU_xx"), ("и", "RU_x"), ("Paris", "EN_Xx"),
    ("Санкт-Петербург", "RU_Xx-Xx"), ("iPhone", "EN_OTHER"), ("日本", "OTHER"), ("ok2", "EN_xx")])
def test_shapes(spark, token, want):
    assert one(spark, token, text.shape) == want


def test_top_words_break_ties_by_word(spark):
    df = spark.createDataFrame([(1, "бета альфа бета гамма альфа")], "k int, text string")
    assert [(r["word"], r["n"]) for r in text.top_words(df, "k", limit=2).orderBy("rank").collect()] == [("альфа", 2), ("бета", 2)]


def found(spark, t, pack=RUSSIAN):
    df = spark.createDataFrame([(1, t)], "doc_id int, text string")
    return [(r["position"], r["match"], r["category"]) for r in extract.numbers(df, pack=pack).orderBy("position", "category").collect()]


def test_numbers(spark):
    assert found(spark, "рост 20% и 5 млн") == [(5, "20%", "AMOUNT"), (11, "5 млн", "AMOUNT")]
    assert found(spark, "цена 600 000 руб") == [(5, "600 000 руб", "AMOUNT")]
    assert found(spark, "12.05.2026 и в понедельник") == [(0, "12.05.2026", "DATE"), (13, "в понедельник", "DATE")]
    assert found(spark, "пришло пять человек") == [(7, "пять человек", "WORD")]
    assert found(spark, "самая важная") == [(2, "мая", "DATE")]  # no word boundary before months
    assert found(spark, "2024 год") == [(0, "2024 год", "AMOUNT")]  # the date starts where the amount does
    assert found(spark, None) == []


def test_context_is_cut_and_collapsed(spark):
    df = spark.createDataFrame([(1, "x" * 100 + "\n\n 20% " + "y" * 100)], "doc_id int, text string")
    r = extract.numbers(df).first()
    assert r["position"] == 103 and r["context"] == "x" * 57 + " 20% " + "y" * 49


def test_risks(spark):
    rows = [(1, 0, "Это явное нарушение правил у нас"), (1, 1, "нарушение и ошибка тут у нас"), (1, 2, "риск тут есть"), (1, 3, "всё хорошо у нас тут сегодня"), (2, 0, "РИСК " * 80), (2, 1, "риск " * 80 + "x")]
    df = spark.createDataFrame(rows, "doc_id int, sent_idx int, sentence string")
    got = {(r["doc_id"], r["position"]): (r["triggers"], r["score"], r["rank"]) for r in extract.risks(df).collect()}
    assert got[1, 0] == (["нарушени", "наруш"], 2, 2)
    assert got[1, 1][1:] == (3, 1)
    assert (1, 2) not in got and (1, 3) not in got
    assert (2, 0) not in got and (2, 1) not in got  # 81 words: the blank at the end counts


def test_contained_in_a_table(spark):
    df = spark.createDataFrame([("Большой Риск",)], "t string")
    lexicon = spark.createDataFrame([("риск",), ("нет",)], "word string")
    assert [r["word"] for r in extract.contained_in(df, "t", lexicon).collect()] == ["риск"]


def test_formats(spark):
    df = spark.range(1)
    pick = lambda c: df.select(c.alias("x")).first()["x"]
    assert pick(formats.clock(F.lit(3_723_999))) == "01:02:03"
    assert pick(formats.duration(F.lit(62_000))) == "1:02" and pick(formats.duration(F.lit(62_000), True)) == "01:02" and pick(formats.duration(F.lit(3_723_000))) == "1:02:03"
    assert [pick(formats.worded_duration(F.lit(x))) for x in (5_000, 65_000, 3_665_000)] == ["5 сек", "1 мин 05 сек", "1 ч 01 мин 05 сек"]
    assert pick(formats.day(F.lit(0).cast("long"))) == "01.01.1970 00:00"
    assert pick(formats.escape_xml(F.lit("a<b>&\"'"))) == "a&lt;b&gt;&amp;&quot;&apos;"
    assert pick(formats.file_name(F.lit('a/b:c?'), F.lit(0).cast("long"))) == "a_b_c__1970-01-01_00-00.txt"
    assert pick(formats.file_name(F.lit("  "), F.lit(0).cast("long"))).startswith("Interview_")
    assert len(pick(formats.file_name(F.lit("x" * 200), F.lit(0).cast("long")))) == 80 + 21


def test_pack_without_words(spark):
    assert one(spark, "A. B. Is c. D", lambda c: text.split_sentences(c, Pack())) == ["A. B. Is c.", "D"]

def test_triggers_by_one_walk(spark):
    """Overlapping and repeated words, in the list's order, for texts that are null or empty too; a filter does not walk a text again."""
    words = ["риск", "рис", "b", "ab", "риск", "проблем", "c"]
    df = spark.createDataFrame([("РИСК ab",), ("xyz",), ("",), (None,), ("нет ПРОБЛЕМЫ, рис c",)], "t string")
    rows = df.select(extract.contained(F.col("t"), words).alias("want"), extract.contained_once(F.col("t"), words).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] or [] for r in rows] == [["риск", "рис", "b", "ab"], [], [], [], ["рис", "проблем", "c"]]
    assert [r[0] for r in df.select(extract.contained_once(F.col("t"), ["", "xyz"])).collect()][1] == ["", "xyz"]
    plan = extract.risks(df.selectExpr("1 as doc_id", "2 as sent_idx", "t as sentence"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "instr(" not in plan

"""Numbers and dates in context, trigger words, and substring lookups."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .lexicons import RUSSIAN, Pack
from .text import word_count

FLAGS = "(?iuU)"  # Unicode classes and case folding, as on the reference platform
LEFT, RIGHT, NEAR, GRAM = 60, 50, 5, 4
PART_WORDS, LONGEST_WORD = 500_000, 256  #: the part of a lexicon that one automaton may hold
MOST_WORDS = 2_000_000  #: words of a lexicon that is looked up by automata
PLACE = "array<struct<position:int,match:string>>"


def _walk(text: Column, pattern: str, limit: int | None, seen: Column | None = None) -> Column:
    """array<struct<position, match>> of the matches, or of the first `limit` that start NEAR characters or more
    from all in `seen` and all kept: lengths of what lies between matches add up.  A text is walked once, and
    under a limit the list kept stays short."""
    found = F.regexp_extract_all(text, F.lit(FLAGS + pattern), 0)
    between = F.split(text, FLAGS + pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        at, kept = acc["at"] + F.length(x["b"]), acc["l"]
        more = F.concat(kept, F.array(F.struct(at.alias("position"), x["m"].alias("match")))).cast(PLACE)
        take = F.lit(True) if limit is None else F.size(kept) < limit
        if seen is not None:
            near = lambda h: F.abs(h["position"] - at) < NEAR
            take = take & ~F.exists(acc["s"], near) & ~F.exists(kept, near)
        return F.struct((at + F.length(x["m"])).alias("at"), F.when(take, more).otherwise(kept).alias("l"), acc["s"].alias("s"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACE).alias("l"), (F.array() if seen is None else seen).cast(PLACE).alias("s"))
    return F.aggregate(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")), start, step)["l"]


def _named(found: Column, category: str) -> Column:
    return F.transform(found, lambda h: F.struct(h["position"], h["match"], F.lit(category).alias("category")))


def hits(text: Column, pattern: str, category: str, limit: int | None = None) -> Column:
    """All matches (or the first `limit`) with their start."""
    return _named(_walk(text, pattern, limit), category)


def all_hits(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, i, position, match of every match: rows, not arrays, for texts with very many."""
    found = F.regexp_extract_all(F.col(text), F.lit(FLAGS + pattern), 0)
    between = F.transform(F.split(F.col(text), FLAGS + pattern, -1), lambda b: F.length(b))
    rows = docs.select(key, F.posexplode(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"))).alias("i", "h"))
    till = F.sum(F.col("h.b") + F.length("h.m")).over(Window.partitionBy(key).orderBy("i"))
    return rows.select(key, "i", (till - F.length("h.m")).alias("position"), F.col("h.m").alias("match"))


def number_hits(text: Column, pack: Pack = RUSSIAN, limit: int = 50) -> Column:
    """The first `limit` by position of: amounts, then dates and numbers in words that start NEAR characters or
    more from every hit kept before.  The first `limit` of each kind settle that: a later one has `limit` hits
    before it, and so has all that it keeps off."""
    amounts = _walk(text, pack.amount, limit)
    dates = _walk(text, pack.date, limit, amounts)
    words = _walk(text, pack.word_number, limit, F.concat(amounts, dates))
    return F.slice(F.array_sort(F.concat(_named(amounts, "AMOUNT"), _named(dates, "DATE"), _named(words, "WORD"))), 1, limit)


def context(text: Column, position: Column, match: Column, left: int = LEFT, right: int = RIGHT) -> Column:
    start = F.greatest(position - left, F.lit(0))
    raw = F.substring(text, start + 1, position + F.length(match) + right - start)
    return F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))


def number_list(text: Column, pack: Pack = RUSSIAN, limit: int = 50, hit_list=number_hits) -> Column:
    """array<struct<match, context, position, category>> of the first `limit` numbers by position."""
    return F.transform(hit_list(text, pack, limit), lambda h: F.struct(
        F.trim(h["match"]).alias("match"), context(text, h["position"], h["match"]).alias("context"), h["position"], h["category"]))


def numbers(docs: DataFrame, key: str = "doc_id", text: str = "text", pack: Pack = RUSSIAN, limit: int = 50, hit_list=number_hits) -> DataFrame:
    """key, position, match, context, category: the first `limit` numbers of each document by position."""
    found = docs.select(key, text, F.explode(hit_list(F.col(text), pack, limit)).alias("h"))
    at, m = F.col("h.position"), F.col("h.match")
    return found.select(key, at.alias("position"), F.trim(m).alias("match"), context(F.col(text), at, m).alias("context"), F.col("h.category").alias("category"))


def contained(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """The distinct words of a list that a text holds as substrings, in the list's order."""
    if not words:
        return F.array().cast("array<string>")
    every = F.array(*[F.lit(w) for w in dict.fromkeys(words)])
    # bound as a variable, so that a text is put in lower case once
    return F.transform(F.array(F.lower(text)), lambda low: F.filter(every, lambda w: F.instr(low, w) > 0))[0]


def contained_in(df: DataFrame, text: str, lexicon: DataFrame, word: str = "word", most: int = MOST_WORDS) -> DataFrame:
    """The same for a lexicon that is a table: one row for each text and word in it.  A lexicon of up to `most` words
    of up to LONGEST_WORD characters is cut into parts of PART_WORDS; a part is one automaton a task, so a text is read once a
    part and never copied; the words are collected while the plan is made.  In a larger one a text, known by a number,
    meets the words of which it holds the first GRAM characters, and is then read once; shorter words, which are
    few, meet all.  Null and empty words are in no text."""
    words = lexicon.select(F.col(word)).where(F.length(word) > 0).distinct()
    known = [r[0] for r in words.where(F.length(word) <= LONGEST_WORD).limit(most + 1).collect()]
    if len(known) <= most and words.where(F.length(word) > LONGEST_WORD).isEmpty():
        known.sort()
        parts = [df.withColumn(word, F.explode(_automaton(known[i:i + PART_WORDS])(F.lower(F.col(text))))) for i in range(0, max(len(known), 1), PART_WORDS)]
        return reduce(DataFrame.unionAll, parts)
    words = words.withColumn("_g", F.substring(F.col(word), 1, GRAM))
    rows = stored(df.withColumn("_id", F.monotonically_increasing_id()), "lexicon-texts")
    low = F.lower(F.col(text))
    each = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.transform(
        F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(low, i, n)))))
    near = rows.select("_id", F.explode(each).alias("_g")).join(words, "_g").groupBy("_id").agg(F.collect_set(word).alias("_w"))
    held = F.filter("_w", lambda w: F.contains(low, w))
    return rows.join(near, "_id").withColumn(word, F.explode(held)).drop("_id", "_w")


def _automaton(words: list[str]):
    """Lists of the words that each text holds, by an automaton made once a task."""
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({w for _, w in automaton.iter(t)}) if t and words else [] for t in texts], dtype=object)

    return F.pandas_udf(held, "array<string>")


def contained_once(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """What `contained` gives, for long texts and many words: a text is walked once by an automaton, where `contained` looks
    for each word in turn.  Not repeated where a filter reads it; an empty word, which any text holds, is left to `contained`."""
    words = tuple(dict.fromkeys(words))
    if not words or "" in words:
        return contained(text, words)

    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, i)
        automaton.make_automaton()
        for texts in batches:
            yield pa.array([[words[i] for i in sorted({i for _, i in automaton.iter(t.as_py() or "")})] for t in texts], pa.list_(pa.string()))

    return F.arrow_udf(held, "array<string>").asNondeterministic()(F.lower(text))


def risk_list(sentences: Column, pack: Pack = RUSSIAN, least: int = 5, most: int = 80, limit: int = 20) -> Column:
    """What risks gives, for an array of sentences: array<struct<sentence, triggers, position, score>>."""
    each = F.transform(sentences, lambda x, i: F.struct(x.alias("sentence"), F.when(word_count(x).between(least, most), contained(x, pack.triggers)).otherwise(
        F.array().cast("array<string>")).alias("triggers"), i.alias("position")))
    found = F.filter(each, lambda r: F.size(r["triggers"]) > 0)
    order = F.array_sort(F.transform(found, lambda r: F.struct((-F.size(r["triggers"])).alias("o"), r["position"], r["sentence"], r["triggers"])))
    return F.transform(F.slice(order, 1, limit), lambda r: F.struct(r["sentence"], r["triggers"], r["position"], (-r["o"]).alias("score")))


def risks(sentences: DataFrame, key: str = "doc_id", position: str = "sent_idx", sentence: str = "sentence", pack: Pack = RUSSIAN,
          least: int = 5, most: int = 80, limit: int = 20) -> DataFrame:
    """key, position, sentence, triggers, score, rank: most triggers first, then by position."""
    n = word_count(F.col(sentence))
    found = sentences.where(n.between(least, most)).select(key, F.col(position).alias("position"), F.col(sentence).alias("sentence"), contained_once(F.col(sentence), pack.triggers).alias("triggers"))
    found = found.withColumn("score", F.size("triggers")).where("score > 0")
    order = Window.partitionBy(key).orderBy(F.desc("score"), "position")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

"""Sentences, tokens and words as column expressions and small DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicons import RUSSIAN, Pack

MARK = "\x01"


def boundary_pattern(pack: Pack = RUSSIAN) -> str:
    """A run of sentence marks that ends a sentence, as a Java pattern."""
    names = sorted({a.rstrip(".") for a in pack.abbreviations}, key=lambda a: (-len(a), a))
    start = r"(?:\A|[^\p{L}\p{Nd}.\-])"
    short = rf"(?<!{start}(?iu:{'|'.join(n.replace('.', chr(92) + '.') for n in names)})\.)" if names else ""
    follows = r"(?=[»\")\]”’]*+(?:\z|[\p{Lu}«(\[]|[\s\p{Z}]++(?:\z|[\p{Lu}\p{Nd}«\"(\[—-])))"
    initial = rf"(?!(?<={start}\p{{Lu}}\.) \p{{Lu}})"
    inner = r"(?!(?<=[\p{L}\p{Nd}]\.)[\p{L}\p{Nd}])"
    return rf"([.!?…]++){follows}(?:(?<=[!?…])|(?<=\.){short}{initial}{inner})"


def marked(text: Column, pack: Pack = RUSSIAN) -> Column:
    """The text, which holds no MARK, with a MARK at each boundary."""
    return F.regexp_replace(F.regexp_replace(text, boundary_pattern(pack), "$1" + MARK), "\n(?=\n)", "\n" + MARK)


def trimmed(sentence: Column) -> Column:
    return F.regexp_replace(sentence, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def split_sentences(text: Column, pack: Pack = RUSSIAN) -> Column:
    """array<string> of the sentences of a text; a null text has none."""
    t = marked(F.regexp_replace(F.coalesce(text, F.lit("")), MARK, ""), pack)
    return F.filter(F.transform(F.split(t, MARK, -1), trimmed), lambda s: s != "")


Segmenter = Callable[[Column], Column]


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", segmenter: Segmenter = split_sentences) -> DataFrame:
    """key, sent_idx, sentence."""
    return docs.select(key, F.posexplode(segmenter(F.col(text))).alias("sent_idx", "sentence"))


def word_count(text: Column) -> Column:
    """Words between white space; an empty text counts 1."""
    return F.size(F.split(text, r"\s+"))


def long_sentences(df: DataFrame, least: int = 8, sentence: str = "sentence") -> DataFrame:
    return df.where(word_count(F.col(sentence)) >= least)


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def terms(text: Column, pack: Pack = RUSSIAN, least: int = 3) -> Column:
    """Lower-case terms of letters, digits and hyphens, without stop words."""
    found = _tokens(F.lower(text), r"[\p{L}\p{Nd}-]+")
    stop = F.array(*map(F.lit, pack.stop_words)) if pack.stop_words else F.array().cast("array<string>")
    return F.filter(found, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def topic_words(text: Column, pack: Pack = RUSSIAN, least: int = 4) -> Column:
    found = _tokens(F.lower(text), r"[\p{L}-]+")
    stop = F.array(*map(F.lit, pack.stop_words)) if pack.stop_words else F.array().cast("array<string>")
    return F.filter(found, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def tagging_tokens(text: Column) -> Column:
    """Words and single marks, for taggers."""
    return _tokens(text, r"(?U)\w+|[^\w\s]")


def counted(items: Column) -> Column:
    """array<struct<o, item>> of the distinct items of a row's array<string>, o minus their number: most frequent first, then
    by item."""
    def counts(lists: pa.Array) -> pa.Array:
        found = lists.flatten().dictionary_encode()
        lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        names = max(len(found.dictionary), 1)
        order = pc.array_sort_indices(found.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pair, n = np.unique(np.repeat(np.arange(len(lists)), lengths) * names + place[found.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        by = np.lexsort((pair, -n, pair // names))
        pair, n = pair[by], n[by]
        ends = np.searchsorted(pair // names, np.arange(len(lists) + 1))
        each = pa.StructArray.from_arrays([pa.array(-n), found.dictionary.take(pa.array(order[pair % names] if len(order) else pair))], ["o", "item"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    return F.arrow_udf(counts, "array<struct<o:bigint,item:string>>")(items)


def top_words(df: DataFrame, by: str, text: str = "text", pack: Pack = RUSSIAN, limit: int = 12, least: int = 4) -> DataFrame:
    """by, word, n, rank: the most frequent words of each group; ties in order of the word."""
    counted = df.select(by, F.explode(topic_words(F.col(text), pack, least)).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def shape(token: Column) -> Column:
    """Shape class: NUM, PUNCT_c, or script and case of the letters (RU_Xx, EN_XX, ...)."""
    letters = F.regexp_replace(token, r"\P{L}", "")
    cyrillic = F.length(F.regexp_replace(token, "[^Ѐ-ӿ]", ""))
    latin = F.length(F.regexp_replace(token, "[^A-Za-z]", ""))
    lang = F.when(cyrillic >= latin, "RU_").otherwise("EN_")
    many = F.length(letters) > 1
    case = (
        F.when(token.rlike(r"^\p{Lu}\p{Ll}*-\p{Lu}\p{Ll}*$"), "Xx-Xx")
        .when(letters == "", "OTHER")
        .when(letters.rlike(r"^\p{Lu}+$"), F.when(many, "XX").otherwise("X"))
        .when(letters.rlike(r"^\p{Ll}+$"), F.when(many, "xx").otherwise("x"))
        .when(letters.rlike(r"^\p{Lu}\p{Ll}+$"), "Xx")
        .otherwise("OTHER"))
    return (
        F.when(F.coalesce(token, F.lit("")) == "", "OTHER")
        .when(token.rlike(r"^\p{Nd}+$"), "NUM")
        .when((F.length(token) == 1) & ~token.rlike(r"[\p{L}\p{Nd}]"), F.concat(F.lit("PUNCT_"), token))
        .when((cyrillic == 0) & (latin == 0), "OTHER")
        .when(case == "OTHER", F.when(letters == "", "OTHER").otherwise(F.concat(lang, F.lit("OTHER"))))
        .otherwise(F.concat(lang, case)))


def token_shapes(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return df.select(*keys, F.posexplode(tagging_tokens(F.col(text))).alias("tok_idx", "token")).withColumn("shape", shape(F.col("token")))

"""Entities: a slot for taggers, spans of tags, junk, counts and tokens for boosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import RUSSIAN, Pack
from ..functions.text import MARK as CUT
from ..functions.text import tagging_tokens

#: From tokens (keys, sent_idx, tok_idx, token) to the same with tag.
Tagger = Callable[[DataFrame], DataFrame]


def tokens_of(sents: DataFrame, keys: list[str], sentence: str = "sentence") -> DataFrame:
    return sents.select(*keys, F.posexplode(tagging_tokens(F.col(sentence))).alias("tok_idx", "token"))


def is_name(token: Column) -> Column:
    """Whether the shape of a token is that of a name, RU_Xx, EN_Xx or one of both with a hyphen, told without the shape."""
    plain = token.rlike(r"^\P{L}*+\p{Lu}\P{L}*+\p{Ll}[\P{L}\p{Ll}]*+$") | token.rlike(r"^\p{Lu}\p{Ll}*-\p{Lu}\p{Ll}*$")
    return F.coalesce(plain & token.rlike("[A-Za-zЀ-ӿ]"), F.lit(False))


def shape_runs(sentence: Column) -> Column:
    """array<string>: the spans that shape_run_tagger's tags make of a sentence, in order."""
    names = F.transform(tagging_tokens(sentence), lambda t, i: F.when((i > 0) & is_name(t), t).otherwise(CUT))
    return F.filter(F.transform(F.split(F.array_join(names, " "), CUT, -1), lambda x: F.trim(x)), lambda x: x != "")


def shape_run_spans(sents: DataFrame, key: str = "doc_id", sentence: str = "sentence") -> DataFrame:
    """key, type, text of the spans of all sentences; no token is shuffled."""
    return sents.select(key, F.lit("PER").alias("type"), F.explode(shape_runs(F.col(sentence))).alias("text"))


def shape_run_tagger(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """A stand-in for a trained tagger: runs of capitalised words that don't open the sentence are PER."""
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    name = (F.col("tok_idx") > 0) & is_name(F.col("token"))
    marked = tokens.withColumn("_n", name)
    return marked.withColumn("tag", F.when(~F.col("_n"), "O").when(F.coalesce(F.lag("_n").over(w), F.lit(False)), "I-PER").otherwise("B-PER")).drop("_n")


def spans(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, type, text: B-X with the I-X that follow.  An I-X after another type ends the span and
    is dropped."""
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    kind, label = F.substring("tag", 1, 2), F.expr("substring(tag, 3)")
    before = F.lag("tag").over(w)
    link = (kind == "I-") & F.coalesce(before.isin("", "O") == F.lit(False), F.lit(False)) & (F.expr("substring(tag, 3)") == F.substring(before, 3, 1000))
    runs = tagged.withColumn("_t", label).withColumn("_new", F.when(F.coalesce(link, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    parts = F.sort_array(F.collect_list(F.struct("tok_idx", "token", "tag")))
    out = runs.groupBy(*keys, "_run").agg(F.first("_t").alias("type"), parts.alias("p"))
    out = out.where(F.col("p")[0]["tag"].startswith("B-"))
    return out.select(*keys, F.col("p")[0]["tok_idx"].alias("start"), "type", F.array_join(F.transform("p", lambda x: x["token"]), " ").alias("text"))


def is_junk(text: Column, kind: Column, pack: Pack = RUSSIAN) -> Column:
    n = F.trim(F.lower(text))
    v = pack.vowels
    parts = F.split(n, "-", -1)
    junk = F.length(n) <= 2
    if pack.junk:
        junk = junk | n.isin(*pack.junk)
    junk = junk | n.rlike(f"^[{v}]+(-[{v}]+)*$")
    junk = junk | (n.contains("-") & F.forall(parts, lambda p: p == parts[0]))
    return junk | ((kind == "PER") & ~n.contains(" ") & (F.length(n) < 4))


def entity_counts(found: DataFrame, key: str = "doc_id", pack: Pack = RUSSIAN) -> DataFrame:
    """key, type, text, normalized, count, rank within type: most frequent first, then by text."""
    kept = found.where(~is_junk(F.col("text"), F.col("type"), pack))
    n = kept.groupBy(key, "type", "text").agg(F.count("*").alias("count"))
    order = Window.partitionBy(key, "type").orderBy(F.desc("count"), "text")
    return n.select(key, "type", "text", F.col("text").alias("normalized"), "count", F.row_number().over(order).alias("rank"))


def entity_totals(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    return counts.groupBy(key, "type").agg(F.count("*").alias("distinct_entities"), F.sum("count").alias("mentions"))


def tokens(text: Column, normalized: Column, least: int = 4) -> Column:
    """Surface, normal form, and words of the normal form of `least` letters, in lower case."""
    normal = F.lower(normalized)
    return F.array_union(F.array(F.lower(text), normal), F.filter(F.split(normal, r"\s+"), lambda w: F.length(w) >= least))


def entity_tokens(counts: DataFrame, key: str = "doc_id", least: int = 4) -> DataFrame:
    """key, tokens: the tokens of all entities of a document."""
    return counts.select(key, F.explode(tokens(F.col("text"), F.col("normalized"), least)).alias("t")).groupBy(key).agg(F.sort_array(F.collect_set("t")).alias("tokens"))

"""Sentences of texts too long for one expression: pieces that many tasks cut, with the open ends put together.

A piece ends behind a letter or digit.  What decides on a boundary lies before that: marks, closing brackets and white
space are followed at most by one more character.  Behind a boundary's place at most an abbreviation and the
character before it count, so each piece is given so many characters of the piece before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import RUSSIAN, Pack
from ..functions.text import MARK, marked, split_sentences, trimmed
from ..sources.shared import stored

PIECE = 1 << 20
OPEN = "array<string>"


def _look_back(pack: Pack) -> int:
    return max([4, *(len(a) + 2 for a in pack.abbreviations)])


def piece_rows(docs: DataFrame, key: str, text: str, pack: Pack, piece: int) -> DataFrame:
    """key, piece, before, body: the bodies of a text make it up; before is the end of the body before."""
    # Fixed count, then no way back: linear, and no step of the matcher is kept for a character.
    cut = rf"(?s).{{{piece - 1}}}[^\p{{L}}\p{{Nd}}]*+[\p{{L}}\p{{Nd}}]|.++"
    bodies = docs.select(key, F.regexp_extract_all(F.regexp_replace(F.col(text), MARK, ""), F.lit(cut), 0).alias("_b"))
    before = F.transform(F.col("_b"), lambda b: F.right(b, F.lit(_look_back(pack))))
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), before).alias("before"), F.col("_b").alias("body"))
    return bodies.select(key, F.posexplode(F.slice(zipped, 1, F.size("_b"))).alias("piece", "p")).select(key, "piece", "p.before", "p.body")


def _parts(pack: Pack):
    """The body cut at its boundaries; the characters before it, and marks among them, go."""
    whole = marked(F.concat("before", "body"), pack)
    body = F.regexp_replace(whole, F.concat(F.lit(rf"\A(?s:{MARK}*+[^{MARK}]){{"), F.length("before"), F.lit("}")), F.lit(""))
    return F.split(F.when(F.col("before") == "", whole).otherwise(body), MARK, -1)


def long_text_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", pack: Pack = RUSSIAN, piece: int = PIECE) -> DataFrame:
    """key, sent_idx, sentence, as functions.text.sentences gives with split_sentences.  key names a document and is
    not null.  Texts of up to `piece` characters are cut in their rows.  Longer ones are spread by pieces; a sentence
    that spans pieces is put together from them, so only a sentence is ever held whole."""
    if piece <= _look_back(pack):
        raise ValueError("pieces must be longer than an abbreviation")
    small = F.coalesce(F.length(text), F.lit(0)) <= piece
    short = docs.where(small).select(key, F.posexplode(split_sentences(F.col(text), pack)).alias("sent_idx", "sentence"))
    spread = piece_rows(docs.where(~small), key, text, pack, piece).repartition(key, "piece")
    cut = stored(spread.select(key, "piece", _parts(pack).alias("parts")), "sentence-pieces")
    # A group is what lies between two pieces that hold boundaries: one sentence, then the inner parts of the piece that ends it.
    order = Window.partitionBy(key).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size("parts") > 1
    group = cut.select(key, "piece", ends.cast("int").alias("_e")).select(key, "piece", F.coalesce(F.sum("_e").over(order), F.lit(0)).alias("_g"))
    head = F.struct(F.col("_g").alias("g"), F.col("parts")[0].alias("open"), F.when(ends, F.slice("parts", F.lit(2), F.size("parts") - 2)).otherwise(F.array().cast(OPEN)).alias("inner"))
    tail = F.struct((F.col("_g") + 1).alias("g"), F.element_at("parts", -1).alias("open"), F.array().cast(OPEN).alias("inner"))
    rows = cut.join(group, [key, "piece"]).select(key, "piece", F.explode(F.when(ends, F.array(head, tail)).otherwise(F.array(head))).alias("r"))
    joined = rows.groupBy(key, F.col("r.g").alias("g")).agg(F.sort_array(F.collect_list(F.struct("piece", "r.open", "r.inner"))).alias("_l"))
    found = F.concat(F.array(F.array_join(F.transform("_l", lambda x: x["open"]), "")), F.element_at("_l", -1)["inner"])
    lists = stored(joined.select(key, "g", F.filter(F.transform(found, trimmed), lambda s: s != "").alias("_s")), "sentence-groups")
    earlier = Window.partitionBy(key).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    shift = lists.select(key, "g", F.size("_s").alias("_n")).select(key, "g", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    long = lists.join(shift, [key, "g"]).select(key, "_shift", F.posexplode("_s").alias("i", "sentence"))
    return short.unionByName(long.select(key, (F.col("_shift") + F.col("i")).cast("int").alias("sent_idx"), "sentence"))

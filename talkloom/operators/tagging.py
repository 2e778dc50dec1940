"""Sequence tagging: scores of tags for each token, and the best sequence of tags by constrained Viterbi decoding.

A model is two tables: weights (feature, tag, weight) and transitions (prev, tag, score), in which a pair that is absent
is forbidden and prev START stands before the first token.  A token's score for a tag is the sum of the weights of its
features; a sequence's score is the sum of its tokens' scores and its transitions.  Ties go to the tag that comes first in `tags`,
from the last token to the first.

Sentences are rows with their tokens in an array, so features, scores and decoding need no shuffle; a batch of
sentences is decoded together, a step over all of them for each place.  `decode` takes scores from anywhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shape, tagging_tokens
from .entities import Tagger

START = ""
BIO = ("O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-ORG", "I-ORG")
#: A model's features are held in each Python worker; more than this many are refused.
MOST_FEATURES = 5_000_000
#: Tokens that are decoded together: their scores and those of a step are what a worker holds besides the batch.
TOKENS = 20_000


@dataclass(frozen=True)
class Model:
    """Scores by feature (a list in the order of tags) and transitions[prev][tag]; first[tag] for the first token."""

    tags: tuple[str, ...]
    weights: dict[str, list[float]]
    transitions: list[list[float]]
    first: list[float]


def allowed(prev: str, tag: str) -> bool:
    """Whether tag may follow prev in the BIO scheme: I-X only behind B-X or I-X."""
    return not tag.startswith("I-") or prev[2:] == tag[2:] and prev[:2] in ("B-", "I-")


def bio_transitions(tags: tuple[str, ...] = BIO) -> list[tuple[str, str, float]]:
    """Every pair that BIO allows, with score 0."""
    return [(p, t, 0.0) for p in (START, *tags) for t in tags if allowed(p, t)]


def model(weights: DataFrame, transitions: DataFrame, tags: tuple[str, ...] = BIO) -> Model:
    """The model of two tables; their size is checked before they are read."""
    n = weights.select("feature").distinct().count()
    if n > MOST_FEATURES:
        raise ValueError(f"{n} features; at most {MOST_FEATURES} are held in a worker")
    at = {t: i for i, t in enumerate(tags)}
    table = np.full((len(tags) + 1, len(tags)), -np.inf)
    for r in transitions.where(F.col("tag").isin(*tags) & F.col("prev").isin(START, *tags)).select("prev", "tag", "score").collect():
        table[at.get(r["prev"], len(tags)), at[r["tag"]]] = r["score"]
    held: dict[str, list[float]] = {}
    for r in weights.where(F.col("tag").isin(*tags)).groupBy("feature", "tag").agg(F.sum("weight").alias("weight")).collect():
        held.setdefault(r["feature"], [0.0] * len(tags))[at[r["tag"]]] = r["weight"]
    return Model(tags, held, table[:-1].tolist(), table[-1].tolist())


def features(tokens: str, at: Column) -> Column:
    """Feature names of the token at a place (from 1): the word, its shape, its last three letters, and the words and
    shapes beside it."""
    word = lambda i: F.coalesce(F.lower(F.try_element_at(F.col(tokens), i)), F.lit("<>"))
    form = lambda i: F.coalesce(shape(F.try_element_at(F.col(tokens), i)), F.lit("<>"))
    before = F.when(at > 1, at - 1).otherwise(F.size(tokens) + 1)  # behind the end, where there is none
    name = lambda k, v: F.concat(F.lit(f"{k}="), v)
    return F.array(F.lit("*"), name("w", word(at)), name("s", form(at)), name("e", F.right(word(at), F.lit(3))), name("p", word(before)), name("n", word(at + 1)), name("ps", form(before)), name("ns", form(at + 1)))


def with_features(df: DataFrame) -> DataFrame:
    """df with, for each of its tokens (array<string>), the features."""
    places = F.when(F.size("tokens") > 0, F.sequence(F.lit(1), F.size("tokens"))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("features", F.transform(places, lambda i: features("tokens", i)))


def viterbi(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Numbers of the tags of the best sequences.  scores: tokens x tags, sentence after sentence; -1 in sentences
    that no allowed sequence fits."""
    starts = np.append(0, np.cumsum(lengths)[:-1])
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    out, back = np.full(len(scores), -1, np.int64), np.zeros(scores.shape, np.uint8)
    if not len(order):
        return out
    at, n = starts[order], lengths[order]
    alpha = scores[at] + first
    for t in range(1, int(n[0])):
        live = int(np.searchsorted(-n, -t))  # sentences longer than t
        reach = alpha[:live, :, None] + transitions
        prev = reach.argmax(axis=1)
        back[at[:live] + t] = prev
        alpha[:live] = np.take_along_axis(reach, prev[:, None, :], axis=1)[:, 0] + scores[at[:live] + t]
    tag = np.where(np.isfinite(alpha.max(axis=1)), alpha.argmax(axis=1), -1)
    good = tag >= 0
    at, n, tag = at[good], n[good], tag[good]
    for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
        live = int(np.searchsorted(-n, -t))
        out[at[:live] + t] = tag[:live]
        tag[:live] = back[at[:live] + t, tag[:live]]
    return out


def _tagged(lists: pa.Array, score, m: Model, transitions, first) -> pa.Array:
    """A list of tags for each list of tokens' features or scores; a sentence that nothing fits has the first tag throughout."""
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    best = viterbi(score(lists.flatten()), lengths, transitions, first)
    names = pa.array(m.tags, pa.string()).take(pa.array(np.maximum(best, 0)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), names)


def _in_parts(batches, column: int, keys: int, score, m: Model, names: list[str]):
    """Batches of the first `keys` columns with tags, TOKENS tokens at a time, or one sentence of more."""
    transitions, first = np.array(m.transitions), np.array(m.first)
    for batch in batches:
        ends = np.cumsum(pc.fill_null(batch.column(column).value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS, "right")))
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(keys)), _tagged(part.column(column), score, m, transitions, first)], names)
            lo = hi


def tag_sentences(sents: DataFrame, keys: list[str], m: Model, sentence: str = "sentence") -> DataFrame:
    """keys, tokens, tags of each sentence."""
    return tag_tokens(sents.select(*keys, tagging_tokens(F.coalesce(F.col(sentence), F.lit(""))).alias("tokens")), keys, m)


def tag_tokens(sents: DataFrame, keys: list[str], m: Model) -> DataFrame:
    """keys, tokens, tags of each row of tokens (array<string>)."""
    rows = with_features(sents).select(*keys, "tokens", "features")
    out = rows.select(*keys, "tokens", F.lit(None).cast("array<string>").alias("tags")).schema
    known = pa.array(list(m.weights), pa.string())
    weights = np.array([*m.weights.values(), [0.0] * len(m.tags)])  # the last row is that of features which the model lacks

    def run(batches):
        index = pc.SetLookupOptions(value_set=known)

        def score(tokens: pa.Array) -> np.ndarray:
            n = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.call_function("index_in", [tokens.flatten()], index), len(known)).to_numpy(zero_copy_only=False)
            found, starts = np.zeros((len(n), weights.shape[1])), np.append(0, np.cumsum(n)[:-1])
            for k in range(int(n.max(initial=0))):  # sums in the order of features
                has = n > k
                found[has] += weights[at[starts[has] + k]]
            return found

        yield from _in_parts(batches, len(keys) + 1, len(keys) + 1, score, m, out.names)

    return rows.mapInArrow(run, out)


def decode(scores: DataFrame, keys: list[str], m: Model) -> DataFrame:
    """keys, tok_idx, tag of a table of scores: keys, tok_idx, scores (array<double>, in the order of m.tags)."""
    rows = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tok_idx", "scores"))).alias("p"))
    rows = rows.select(*keys, F.transform("p", lambda x: x["tok_idx"]).alias("at"), F.transform("p", lambda x: x["scores"]).alias("scores"))
    out = rows.select(*keys, "at", F.lit(None).cast("array<string>").alias("tags")).schema
    dense = lambda tokens: tokens.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(m.tags))

    def run(batches):
        yield from _in_parts(batches, len(keys) + 1, len(keys) + 1, dense, m, out.names)

    tagged = rows.mapInArrow(run, out)
    return tagged.select(*keys, F.explode(F.arrays_zip("at", "tags")).alias("x")).select(*keys, F.col("x.at").alias("tok_idx"), F.col("x.tags").alias("tag"))


def exploded(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tok_idx, token, tag of what tag_sentences gives."""
    return tagged.select(*keys, F.posexplode(F.arrays_zip("tokens", "tags")).alias("tok_idx", "x")).select(*keys, "tok_idx", F.col("x.tokens").alias("token"), F.col("x.tags").alias("tag"))


def viterbi_tagger(m: Model, keys: list[str]) -> Tagger:
    """A tagger for `report.summaries` and `entities`: from tokens of sentences to the same with tags."""

    def tagger(tokens: DataFrame) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("tok_idx", "token")))
        sents = tokens.groupBy(*keys).agg(F.transform(parts, lambda x: x["token"]).alias("tokens"))
        return exploded(tag_tokens(sents, keys, m), keys)

    return tagger


def fit(tagged: DataFrame, keys: list[str], tags: tuple[str, ...] = BIO, smooth: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """weights and transitions of a model from tagged tokens (keys, tok_idx, token, tag): log shares of features within
    a tag and of tags behind a tag, smoothed; transitions that BIO forbids stay out.  Counts are grouped sums."""
    parts = tagged.where(F.col("tag").isin(*tags)).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tok_idx", "token", "tag"))).alias("p"))
    rows = parts.select(*keys, F.transform("p", lambda x: x["token"]).alias("tokens"), F.transform("p", lambda x: x["tag"]).alias("tags"))
    places = F.sequence(F.lit(1), F.size("tokens"))
    seen = rows.select(F.explode(F.arrays_zip(F.transform(places, lambda i: features("tokens", i)).alias("f"), F.col("tags").alias("t"))).alias("x"))
    counts = seen.select(F.col("x.t").alias("tag"), F.explode("x.f").alias("feature")).groupBy("feature", "tag").agg(F.count("*").alias("n"))
    whole = counts.where("feature = '*'").select("tag", F.col("n").alias("of"))
    known = counts.select("feature").distinct()
    every = known.withColumn("tag", F.explode(F.array(*map(F.lit, tags)))).join(counts, ["feature", "tag"], "left").join(F.broadcast(whole), "tag")  # a row for each tag
    weights = every.select("feature", "tag", F.ln((F.coalesce("n", F.lit(0)) + smooth) / (F.col("of") + 2 * smooth)).alias("weight"))
    steps = rows.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit(START)), F.slice("tags", F.lit(1), F.size("tags") - 1)).alias("a"), F.col("tags").alias("b"))).alias("x"))
    steps = steps.groupBy(F.col("x.a").alias("prev"), F.col("x.b").alias("tag")).agg(F.count("*").alias("n"))
    pairs = tagged.sparkSession.createDataFrame([(p, t) for p, t, _ in bio_transitions(tags)], "prev string, tag string")
    both = pairs.join(steps, ["prev", "tag"], "left")
    of = F.sum(F.coalesce("n", F.lit(0)) + smooth).over(Window.partitionBy("prev"))
    return weights, both.select("prev", "tag", F.ln((F.coalesce("n", F.lit(0)) + smooth) / of).alias("score"))

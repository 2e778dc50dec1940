"""Key sentences: TF-IDF, similarity edges, PageRank per document, boosts and top-k."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import RUSSIAN, Pack
from ..functions.text import terms, word_count
from ..sources.shared import stored
from .cosine import PARTS, SLACK, cosine_join

#: Sentences of a document whose graph one task takes: at most MOST * MOST similarities.
MOST = 2000
#: Changed sentences of a round up to this number are broadcast to the edges; more are joined by a shuffle.  What all rounds
#: send through the driver is thus bounded, whatever the number of sentences.
BROADCAST_CHANGES = 10_000


@dataclass(frozen=True)
class RankSettings:
    pack: Pack = RUSSIAN
    min_df: int = 2
    max_df_ratio: float = 0.85
    least_term: int = 3
    threshold: float = 0.10
    #: A cosine that is less than the threshold by no more than this counts; 0 compares as SQL does.
    slack: float = SLACK
    damping: float = 0.85
    max_iterations: int = 50
    tolerance: float = 1e-6

    @property
    def rest(self) -> float:
        """1 - damping as decimals subtract: 0.15 for 0.85, for which doubles give a little more."""
        return float(1 - Decimal(str(self.damping)))


@dataclass(frozen=True)
class BoostSettings:
    entity_base: float = 1.5
    entity_step: float = 0.1
    entity_cap: int = 5
    number: float = 1.3
    ideal_min: int = 15
    ideal_max: int = 60
    ideal: float = 1.2
    short: int = 10
    short_penalty: float = 0.5


@F.arrow_udf(T.DoubleType())
def log(x: pa.Array) -> pa.Array:
    """The logarithm of the C library, which SQL engines use too; Spark's own often differs in the last bit."""
    return pc.ln(x)


def tf_idf(sents: DataFrame, key: str = "doc_id", idx: str = "sent_idx", sentence: str = "sentence", s: RankSettings = RankSettings()) -> DataFrame:
    """key, idx, term, w: weights of length 1 per sentence, squares added in the order of terms.  n counts all sentences, also
    those without terms."""
    tokens = sents.select(key, idx, F.explode(terms(F.col(sentence), s.pack, s.least_term)).alias("term"))
    tf = tokens.groupBy(key, idx, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(key, "term").agg(F.count("*").alias("df"))
    n = sents.groupBy(key).agg(F.count("*").alias("n"))
    kept = df.join(n, key).where((F.col("df") >= s.min_df) & (F.col("df") <= F.greatest(F.floor(s.max_df_ratio * F.col("n")), F.lit(s.min_df))))
    idf = log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weighted = tf.join(kept.select(key, "term", idf.alias("idf")), [key, "term"]).select(key, idx, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    by_term = Window.partitionBy(key, idx).orderBy("term").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(by_term))
    return weighted.select(key, idx, "term", (F.col("raw") / length).alias("w"))


def similarity(weights: DataFrame, key: str = "doc_id", idx: str = "sent_idx", threshold: float = 0.10, slack: float = SLACK) -> DataFrame:
    """key, src, dst, w in both directions, by a pruned inverted index within a document."""
    up = cosine_join(weights, threshold, key, idx, slack)
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return up.select(key, ends.alias("e"), "w").select(key, "e.src", "e.dst", "w")


def page_rank(edges: DataFrame, sents: DataFrame, key: str = "doc_id", idx: str = "sent_idx", s: RankSettings = RankSettings()) -> DataFrame:
    """key, idx, base for every sentence.  A document's graph is iterated in one grouped map until its own
    tolerance; a sentence without edges has (1 - d) / n, and a document's only sentence 1."""
    n = sents.groupBy(key).agg(F.count("*").alias("n"))
    rows = edges.join(n, key)
    kind = dict(edges.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        node, at = np.unique(pdf["src"].to_numpy(), return_inverse=True)
        to = np.searchsorted(node, pdf["dst"].to_numpy())
        w = pdf["w"].to_numpy(float)
        share = w / np.bincount(at, w)[at]
        score = np.full(len(node), 1.0 / n)
        lone, lone_next = n - len(node), s.rest / n
        lone_score = 1.0 / n
        for _ in range(s.max_iterations):
            new = s.rest / n + s.damping * np.bincount(to, share * score[at], len(node))
            change = np.abs(new - score).sum() + lone * abs(lone_next - lone_score)
            score, lone_score = new, lone_next
            if change < s.tolerance:
                break
        return pd.DataFrame({key: pdf[key].iloc[0], idx: node, "base": score})

    ranked = rows.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {idx} {kind['src']}, base double")
    lone = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(s.rest / F.col("n"))
    return sents.select(key, idx).join(n, key).join(ranked, [key, idx], "left").select(key, idx, F.coalesce("base", lone).alias("base"))


def page_rank_relational(edges: DataFrame, sents: DataFrame, key: str = "doc_id", idx: str = "sent_idx", s: RankSettings = RankSettings()) -> DataFrame:
    """The same for graphs too large for one task, by delta iteration.

    A sentence starts at 1 / n.  Its change is sent along its edges only while it is above a bound, a share of the
    tolerance; smaller changes are kept until they add up.  What is kept in the end moves no score by more than
    the tolerance.  A document stops once none of its sentences has such a change, and a round shuffles
    the edges of changed sentences alone.  Changes are a table a round; scores are their sums, made once."""
    out_w = Window.partitionBy(key, "src")
    share = stored(edges.select(key, "src", "dst", (F.col("w") / F.sum("w").over(out_w) * s.damping).alias("share")), "rank-edges")
    n = sents.groupBy(key).agg(F.count("*").alias("n"))
    nodes = stored(sents.select(key, idx).join(n, key), "rank-nodes")
    first = share.join(nodes.select(key, F.col(idx).alias("src"), "n"), [key, "src"]).groupBy(key, F.col("dst").alias(idx)).agg(F.sum(F.col("share") / F.col("n")).alias("got"))
    change = F.coalesce("got", F.lit(0.0)) + s.rest / F.col("n") - 1 / F.col("n")
    now, sent = changed(nodes.join(first, [key, idx], "left").select(key, idx, "n", change.alias("change")), s)
    rounds = [now]
    while sent and len(rounds) < s.max_iterations:
        moving = now.where("sent").select(key, F.col(idx).alias("src"), "n", "change")
        got = share.join(F.broadcast(moving) if sent <= BROADCAST_CHANGES else moving.hint("merge"), [key, "src"]).select(key, F.col("dst").alias(idx), "n", (F.col("share") * F.col("change")).alias("change"))
        both = got.unionByName(now.where("not sent").select(key, idx, "n", "change")).groupBy(key, idx).agg(F.first("n").alias("n"), F.sum("change").alias("change"))
        now, sent = changed(both, s)
        rounds.append(now)
    done = [r.where("sent") for r in rounds[:-1]] + [rounds[-1]]
    total = done[0].select(key, idx, "change")
    for r in done[1:]:
        total = total.unionByName(r.select(key, idx, "change"))
    total = total.groupBy(key, idx).agg(F.sum("change").alias("change"))
    base = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(1 / F.col("n") + F.coalesce("change", F.lit(0.0)))
    return nodes.join(total, [key, idx], "left").select(key, idx, base.alias("base"))


def changed(changes: DataFrame, s: RankSettings) -> tuple[DataFrame, int]:
    """The changes as a table with sent, whether one is large enough to be passed on, and how many are.  All that n
    sentences keep comes to less than tolerance * (1 - damping), and so moves the scores by less than the tolerance."""
    seen = Observation()
    large = F.abs("change") > s.tolerance * s.rest / F.col("n")
    table = stored(changes.withColumn("sent", large).observe(seen, F.count_if("sent").alias("sent")), "rank-change")
    return table, seen.get["sent"]


def listed_scores(sentence_terms: Column, s: RankSettings = RankSettings()) -> Column:
    """array<double>: what tf_idf, similarity and page_rank give for the sentences of a document, from the terms of each
    (array<array<string>>).  A batch's weights are made at once, then each document's graph in turn, so that no term
    or pair of sentences leaves the task.  Squares are added in the order of terms, whatever else is in the batch.  For
    documents of MOST sentences or fewer; null gives null."""
    def scores(docs: pa.Array) -> pa.Array:
        sents = docs.flatten()
        terms = sents.flatten().dictionary_encode()
        n_sents = pc.fill_null(docs.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n_terms = pc.fill_null(sents.value_lengths(), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(n_sents)])
        doc_of = np.repeat(np.arange(len(docs)), n_sents)
        names = max(len(terms.dictionary), 1)
        place = np.argsort(pc.sort_indices(terms.dictionary).to_numpy())
        pair, tf = np.unique(np.repeat(np.arange(len(sents)), n_terms) * names + place[terms.indices.to_numpy(zero_copy_only=False)], return_counts=True)
        sent, term = pair // names, pair % names
        doc = doc_of[sent]
        _, at, df = np.unique(doc * names + term, return_inverse=True, return_counts=True)
        df, n = df[at], n_sents[doc]
        kept = (df >= s.min_df) & (df <= np.maximum(np.floor(s.max_df_ratio * n), s.min_df))
        sent, doc, at, raw = sent[kept], doc[kept], at[kept], (tf * (pc.ln((1 + n) / (1 + df)).to_numpy() + 1))[kept]
        w = raw / np.sqrt(np.bincount(sent, raw * raw, len(sents)))[sent]
        base = np.where(n_sents == 1, 1.0, s.rest / np.maximum(n_sents, 1))[doc_of]
        edge = np.searchsorted(doc, np.arange(len(docs) + 1))
        for d in np.flatnonzero((np.diff(edge) > 0) & (n_sents > 1)):
            part = slice(edge[d], edge[d + 1])
            node, row = np.unique(sent[part], return_inverse=True)
            base[node] = _graph_scores(row, np.unique(at[part], return_inverse=True)[1], w[part], len(node), int(n_sents[d]), s)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(base), mask=docs.is_null() if docs.null_count else None)

    return F.arrow_udf(scores, "array<double>")(sentence_terms)


def _graph_scores(row: np.ndarray, term: np.ndarray, w: np.ndarray, nodes: int, n: int, s: RankSettings) -> np.ndarray:
    """PageRank of the sentences with terms, among n, from a row of weights for each sentence."""
    alike = np.zeros((nodes, nodes))
    wide = max(1, 2_000_000 // nodes)
    for lo in range(0, int(term.max()) + 1, wide):
        use = (term >= lo) & (term < lo + wide)
        part = np.zeros((nodes, min(wide, int(term.max()) + 1 - lo)))
        part[row[use], term[use] - lo] = w[use]
        alike += part @ part.T
    np.fill_diagonal(alike, 0)
    a, b = np.nonzero(np.abs(alike - (s.threshold - s.slack)) < SLACK)
    alike[a, b] = _products(row, term, w, a, b)
    alike[alike < s.threshold - s.slack] = 0
    total = alike.sum(axis=1)
    share = alike / np.where(total > 0, total, 1)[:, None]
    score, alone, lone = np.full(nodes, 1.0 / n), 1.0 / n, s.rest / n
    for _ in range(s.max_iterations):
        new = lone + s.damping * (score @ share)
        change = np.abs(new - score).sum() + (n - nodes) * abs(lone - alone)
        score, alone = new, lone
        if change < s.tolerance:
            break
    return score


def _products(row: np.ndarray, term: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each pair of rows a and b as cosine_join adds it, whose sum does not hang on an order."""
    out, names = np.zeros(len(a)), int(term.max()) + 1
    code, start = row * names + term, np.searchsorted(row, np.arange(row[-1] + 2))
    for lo in range(0, len(a), 100_000):
        x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
        size = start[x + 1] - start[x]
        first = np.cumsum(size) - size
        at = np.repeat(start[x] - first, size) + np.arange(size.sum())
        want = np.repeat(y, size) * names + term[at]
        found = np.minimum(np.searchsorted(code, want), len(code) - 1)
        part = np.where(code[found] == want, np.rint(w[at] * w[found] * PARTS), 0).astype(np.int64)
        out[lo : lo + 100_000] = np.add.reduceat(part, first) / PARTS
    return out


def ranked_lists(rows: DataFrame, items: str, key: str = "doc_id", s: RankSettings = RankSettings(), most: int | None = MOST) -> DataFrame:
    """The rows (one a key) with base array<double> for items, array<struct<sent_idx, sentence>> in order of sent_idx.  Documents of
    more than `most` sentences are ranked by joins.  rows is read again for these alone; most=None leaves the look
    for them out, where a caller knows of none."""
    each = F.transform(items, lambda x: terms(x["sentence"], s.pack, s.least_term))
    if most is None:
        return rows.withColumn("base", listed_scores(each, s))
    scored = rows.withColumn("base", listed_scores(F.when(F.size(items) <= most, each), s))
    large = rows.where(F.size(items) > most)
    if large.isEmpty():
        return scored
    sents = stored(large.select(key, F.inline(items)), "rank-large")
    joined = page_rank_relational(similarity(tf_idf(sents, key, s=s), key, threshold=s.threshold, slack=s.slack), sents, key, s=s)
    listed = joined.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "base"))), lambda x: x["base"]).alias("_joined"))
    return scored.join(listed, key, "left").withColumn("base", F.coalesce("base", "_joined")).drop("_joined")


def _scored(sents: DataFrame, key: str, idx: str, sentence: str, s: RankSettings, most: int | None) -> DataFrame:
    """key, idx, sentence, base, n: one shuffle of the sentences by their document.  Only documents of `most` sentences or
    fewer become a list; the others are ranked by joins."""
    kind = dict(sents.dtypes)[idx]
    counts = sents.groupBy(key).agg(F.count("*").alias("n"))
    large = None if most is None else counts.where(F.col("n") > most)
    joined = None
    if large is not None and not large.isEmpty():
        few, many = sents.join(large, key, "left_anti"), stored(sents.join(large, key, "left_semi").select(key, idx, sentence), "rank-large")
        base = page_rank_relational(similarity(tf_idf(many, key, idx, sentence, s), key, idx, s.threshold, s.slack), many, key, idx, s)
        joined = many.join(base, [key, idx]).join(many.groupBy(key).agg(F.count("*").alias("n")), key).select(key, idx, sentence, "base", "n")
        sents = few
    lists = sents.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("sent_idx"), F.col(sentence).alias("sentence")))).alias("_items"))
    out = ranked_lists(lists, "_items", key, s, None).select(key, F.size("_items").cast("long").alias("n"), F.inline(F.arrays_zip("_items", "base")))
    out = out.select(key, F.col("_items.sent_idx").cast(kind).alias(idx), F.col("_items.sentence").alias(sentence), "base", "n")
    return out if joined is None else out.unionByName(joined)


def base_scores(sents: DataFrame, key: str = "doc_id", idx: str = "sent_idx", sentence: str = "sentence", s: RankSettings = RankSettings(), most: int | None = MOST) -> DataFrame:
    """key, idx, base.  Documents of more than `most` sentences are ranked by joins, the others as lists."""
    return _scored(sents, key, idx, sentence, s, most).select(key, idx, "base")


def rounded(x: Column, digits: int) -> Column:
    """x, not negative, rounded by x * 10 ** digits, as SQL engines round doubles; F.round goes by x as it is written, and then
    a half that a product misses by its last bit goes down."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def factor(sentence: Column, held: Column | None = None, b: BoostSettings = BoostSettings(), base: Column | None = None) -> Column:
    """Multiplier for `held` entities, digits, and length; with base, base times the three, one after another."""
    out = F.lit(1.0) if base is None else base
    if held is not None:
        out = out * F.when(held > 0, b.entity_base + b.entity_step * F.least(held, F.lit(b.entity_cap))).otherwise(1.0)
    n = word_count(sentence)
    return out * F.when(sentence.rlike(r"\d"), b.number).otherwise(1.0) * (
        F.when(n.between(b.ideal_min, b.ideal_max), b.ideal).when(n < b.short, b.short_penalty).otherwise(1.0))


def boost(sentence: Column, entities: Column | None = None, b: BoostSettings = BoostSettings(), base: Column | None = None) -> Column:
    """The same for an array of lower-case strings, each of which is looked for in the sentence."""
    if entities is None:
        return factor(sentence, None, b, base)
    return factor(sentence, F.size(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.instr(F.lower(sentence), e) > 0)), b, base)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def strings_held(sentences: pd.Series, strings: pd.Series) -> pd.Series:
    """For each sentence of a document the number of the document's strings that it holds, by one automaton a
    document: linear in the text, however many strings there are."""
    import ahocorasick

    out = []
    for texts, words in zip(sentences, strings, strict=True):
        words = [] if words is None else [w for w in words if w]
        if not words or texts is None:
            out.append([0] * len(texts if texts is not None else ()))
            continue
        automaton = ahocorasick.Automaton()
        for i, w in enumerate(dict.fromkeys(words)):
            automaton.add_word(w, i)
        automaton.make_automaton()
        out.append([len({i for _, i in automaton.iter(t)}) for t in texts])
    return pd.Series(out)


def lex_rank(sents: DataFrame, key: str = "doc_id", idx: str = "sent_idx", sentence: str = "sentence", s: RankSettings = RankSettings(),
             b: BoostSettings | None = BoostSettings(), entities: DataFrame | None = None, most: int | None = MOST) -> DataFrame:
    """key, idx, sentence, base, boosted.  entities: key and tokens array<string>.  An only sentence is not boosted."""
    scored = _scored(sents, key, idx, sentence, s, most)
    tokens = None
    if entities is not None:
        scored, tokens = scored.join(entities.select(key, "tokens"), key, "left"), F.col("tokens")
    boosted = boost(F.col(sentence), tokens, b, F.col("base")) if b else F.col("base")
    return scored.select(key, idx, sentence, "base", F.when(F.col("n") == 1, F.col("base")).otherwise(boosted).alias("boosted"))


def top_k(scored: DataFrame, k: int, key: str = "doc_id", idx: str = "sent_idx", by: str = "boosted") -> DataFrame:
    """The k best of each document with their rank; ties go to the earlier sentence."""
    order = Window.partitionBy(key).orderBy(F.desc(by), idx)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_in_order(scored: DataFrame, k: int, key: str = "doc_id", idx: str = "sent_idx", by: str = "boosted") -> DataFrame:
    """The same, with `place` in the order of the text."""
    return top_k(scored, k, key, idx, by).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(idx)))


def best_of_lists(rows: DataFrame, k: int, items: str, key: str = "doc_id", s: RankSettings = RankSettings(), b: BoostSettings = BoostSettings(), digits: int = 6) -> DataFrame:
    """key, sent_idx, sentence, base, boosted, rank: what lex_rank and top_k give for rows with a document's sentences as a list (see
    ranked_lists), scores rounded before they are ranked.  Made in the row: no sentence is shuffled."""
    def place(x: Column) -> Column:
        boosted = F.when(F.size(items) == 1, x["base"]).otherwise(factor(x["i"]["sentence"], None, b, x["base"]))
        return F.struct((-rounded(boosted, digits)).alias("o"), x["i"]["sent_idx"].alias("sent_idx"), x["i"]["sentence"].alias("sentence"), rounded(x["base"], digits).alias("base"))

    best = F.array_sort(F.transform(F.arrays_zip(F.col(items).alias("i"), F.col("base").alias("base")), place))
    each = ranked_lists(rows, items, key, s).select(key, F.posexplode(F.slice(best, 1, k)).alias("p", "x"))
    return each.select(key, "x.sent_idx", "x.sentence", "x.base", (-F.col("x.o")).alias("boosted"), (F.col("p") + 1).alias("rank"))

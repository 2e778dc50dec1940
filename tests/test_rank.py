import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.functions.lexicons import RUSSIAN, TEST
from talkloom.operators import cosine, rank
from talkloom.plans import catalog


def sents(spark, *docs):
    rows = [(d, i, s) for d, ss in enumerate(docs) for i, s in enumerate(ss)]
    return spark.createDataFrame(rows, "doc_id int, sent_idx int, sentence string")


TALK = ["красный трактор работает поле утром", "красный трактор стоит поле вечером", "синий комбайн работает поле утром", "совсем другая тема разговора", "синий комбайн красный трактор"]


def test_one_two_and_lonely_sentences(spark):
    df = sents(spark, ["одно предложение"], ["равные слова здесь", "равные слова здесь"], TALK)
    got = {(r["doc_id"], r["sent_idx"]): (r["base"], r["boosted"]) for r in rank.lex_rank(df).collect()}
    assert got[0, 0] == (1.0, 1.0)
    assert got[1, 0][0] == pytest.approx(got[1, 1][0])
    assert got[2, 3][0] == pytest.approx(0.15 / 5)  # no edges
    assert all(b >= 0.15 / 5 - 1e-12 for (d, _), (b, _) in got.items() if d == 2)


def test_term_in_most_sentences_is_pruned(spark):
    df = sents(spark, [f"общий слово{i // 2}" for i in range(20)])
    terms = {r["term"] for r in rank.tf_idf(df).collect()}
    assert "общий" not in terms and "слово3" in terms


def test_similarity_is_symmetric_and_bounded(spark):
    e = rank.similarity(rank.tf_idf(sents(spark, TALK))).collect()
    w = {(r["src"], r["dst"]): r["w"] for r in e}
    assert w and all(w[b, a] == x and 0.1 <= x <= 1 + 1e-9 for (a, b), x in w.items())


def test_both_page_ranks_agree(spark):
    df = sents(spark, TALK, TALK[:3], ["одно"])
    edges = rank.similarity(rank.tf_idf(df))
    a = {(r[0], r[1]): r[2] for r in rank.page_rank(edges, df).collect()}
    b = {(r[0], r[1]): r[2] for r in rank.page_rank_relational(edges, df).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_delta_iteration_sends_less_and_less(spark, monkeypatch):
    """Rounds end by themselves, each sends fewer changes once scores settle, and what is kept moves no score by more than
    the tolerance."""
    rng = random.Random(4)
    words = [f"слово{i}" for i in range(60)]
    df = sents(spark, [" ".join(rng.choice(words) for _ in range(9)) for _ in range(150)], TALK, ["равные слова здесь"] * 2)
    edges = rank.similarity(rank.tf_idf(df)).cache()
    exact = {(r[0], r[1]): r[2] for r in rank.page_rank(edges, df, s=rank.RankSettings(tolerance=0.0, max_iterations=300)).collect()}
    tables, made = [], rank.changed

    def watched(*args):
        tables.append(0)
        table, tables[-1] = made(*args)
        return table, tables[-1]

    monkeypatch.setattr(rank, "changed", watched)
    for bound in (0, 500_000):
        monkeypatch.setattr(rank, "BROADCAST_CHANGES", bound)
        tables.clear()
        got = {(r[0], r[1]): r[2] for r in rank.page_rank_relational(edges, df).collect()}
        assert got.keys() == exact.keys() and max(abs(got[k] - exact[k]) for k in got) < 1e-6
        assert tables[-1] == 0 and tables[0] > 100 and len(tables) < 50 and sum(tables[len(tables) // 2 :]) < sum(tables[: len(tables) // 2])


def test_changes_over_the_bound_are_not_broadcast(spark, monkeypatch):
    """Spark does not send them through the driver on its own account either, however small their files are."""
    edges = spark.createDataFrame([(1, i, j, 1.0) for i in range(12) for j in range(12) if i != j and (i + j) % 3], "doc_id long, src long, dst long, w double")
    sents, plans, made = edges.select("doc_id", F.col("src").alias("sent_idx")).distinct(), [], rank.changed

    def watched(changes, s):
        table, sent = made(changes, s)
        plans.append((changes._jdf.queryExecution().executedPlan().toString(), sent))
        return table, sent

    monkeypatch.setattr(rank, "changed", watched)
    monkeypatch.setattr(rank, "BROADCAST_CHANGES", 0)
    rank.page_rank_relational(edges, sents).collect()
    assert len(plans) > 2 and rank.BROADCAST_CHANGES == 0
    assert not any("BroadcastHashJoin" in plan for plan, _ in plans[1:])


def vectors(seed, n):
    """Sparse vectors of length 1 with common and rare terms, some equal, some of one term."""
    rng = random.Random(seed)
    rows = []
    for d in (1, 2):
        for i in range(n):
            terms = {f"c{rng.randrange(6)}": rng.uniform(0.05, 0.4) for _ in range(rng.randint(0, 4))} | {f"r{rng.randrange(300)}": rng.uniform(0.5, 3) for _ in range(rng.randint(0 if i % 9 else 1, 5))}
            if i % 17 == 0:
                terms = {"c1": 1.0}
            length = sum(w * w for w in terms.values()) ** 0.5
            rows += [(d, i, t, w / length) for t, w in terms.items()]
    return rows


@pytest.mark.parametrize("threshold", [0.02, 0.1, 0.4, 0.8, 0.999])
def test_pruned_join_finds_every_pair(spark, threshold):
    rows = vectors(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, term string, w double")
    by = {}
    for d, i, t, w in rows:
        by.setdefault((d, i), {})[t] = w
    want = {}
    for (d, i), x in by.items():
        for (e, j), y in by.items():
            if d == e and i < j and (p := sum(w * y.get(t, 0) for t, w in x.items())) >= threshold:
                want[d, i, j] = p
    got = {(r["doc_id"], min(r["src"], r["dst"]), max(r["src"], r["dst"])): r["w"] for r in cosine.cosine_join(df, threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want
    split = cosine.split_vectors(df, "doc_id", "sent_idx", threshold)
    assert threshold < 0.1 or split.agg(F.sum(F.size("head"))).first()[0] > 50


def test_product_at_the_threshold_counts(spark):
    """1 / sqrt(5 * 20) in the doubles that one order of the sum of squares gives, which come to a little less than 0.1."""
    a, b = 0.4472135954999579, 0.22360679774997896
    assert a * b < 0.1
    df = spark.createDataFrame([(1, 0, "t", a), (1, 1, "t", b), (1, 0, "x", (1 - a * a) ** 0.5), (1, 1, "y", (1 - b * b) ** 0.5)], "doc_id long, sent_idx int, term string, w double")
    assert {(r["src"], r["dst"]) for r in rank.similarity(df).collect()} == {(0, 1), (1, 0)}


def test_weights_have_the_bits_of_sql(spark):
    """Logarithms of the C library, squares added in the order of terms, whatever the order of rows."""
    same = [f"wa{chr(97 + i)}" for i in range(9)] + ["xx" + chr(97 + i) for i in range(2) for _ in range(2)]
    df = sents(spark, [" ".join(same), " ".join(sorted(same, reverse=True)), *["einsam"] * 6])
    idf = math.log(9 / 3) + 1
    squares = 0.0
    for tf in [1] * 9 + [2] * 2:
        squares += (tf * idf) * (tf * idf)
    got = {(r["sent_idx"], r["term"]): r["w"] for n in (1, 7) for r in rank.tf_idf(df.repartition(n), s=rank.RankSettings(pack=TEST)).collect()}
    assert got[0, "waa"] == got[1, "waa"] == idf / math.sqrt(squares) and got[0, "xxa"] == 2 * idf / math.sqrt(squares)


def test_product_below_the_threshold_in_doubles(spark):
    """Without slack a cosine is compared as SQL compares it: 1 / sqrt(5 * 20) in these doubles is too small."""
    a, b = 0.4472135954999579, 0.22360679774997896
    rows = [(1, 0, "t", a), (1, 1, "t", b), (1, 0, "x", (1 - a * a) ** 0.5), (1, 1, "y", (1 - b * b) ** 0.5), (2, 0, "t", 0.5), (2, 1, "t", 0.2), (2, 0, "x", 0.75**0.5), (2, 1, "y", 0.96**0.5)]
    df = spark.createDataFrame(rows, "doc_id long, sent_idx int, term string, w double")
    assert 0.5 * 0.2 >= 0.1 > a * b
    assert {(r["doc_id"], r["src"], r["dst"]) for r in rank.similarity(df, slack=0.0).collect()} == {(2, 0, 1), (2, 1, 0)}


#: Turns whose cosine is 1 / sqrt(5 * 20) but in doubles less, in any order of the sums: 5 terms that a turn shares with the others, 18 with 16
#: once and one twice (n is 5).
SHORT, LONG = ["oned", *[f"ka{c}" for c in "abcd"]], ["oned", *[f"la{chr(97 + i)}" for i in range(15)], "lzz", "lzz"]


def tied_turns(spark, path):
    """That pair, its terms dealt to two more turns, and a turn apart; 48 and 32 turns without terms, whose scores end in a half."""
    texts = [" ".join(SHORT), " ".join(LONG), " ".join(SHORT[1:]), " ".join(dict.fromkeys(LONG[1:])), "ganz anderes"]
    docs = [(1, texts), (2, ["a b"] * 48), (3, ["a 1 " * 10] * 32)]
    spark.createDataFrame([(d, i, "user", t.strip()) for d, ts in docs for i, t in enumerate(ts)], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def by_sql(path, name):
    with duckdb.connect() as c:
        c.execute(f"create view conversations as select * from read_parquet('{path}/conversations.parquet/*.parquet')")
        return sorted(c.execute(catalog.ORACLES[name]).fetchall())


def test_similarity_edges_at_the_threshold_equal_sql(spark, tmp_path):
    path = tied_turns(spark, tmp_path)
    got = sorted(tuple(r) for r in catalog.similarity_edges(spark, path).collect())
    assert got == by_sql(path, "similarity_edges") and got and (1, 0, 1) not in {r[:3] for r in got}


def test_delta_ranks_at_the_threshold_equal_sql(spark, tmp_path):
    path = tied_turns(spark, tmp_path)
    assert sorted(tuple(r) for r in catalog.delta_ranks(spark, path).collect()) == by_sql(path, "delta_ranks")


def test_lexrank_scores_at_the_threshold_and_at_halves_equal_sql(spark, tmp_path):
    path = tied_turns(spark, tmp_path)
    got, want = ({r[:2]: r[2:] for r in rows} for rows in (catalog.lexrank_scores(spark, path).collect(), by_sql(path, "lexrank_scores")))
    assert got == want and got[2, 0] == (0.003125, 0.001562) and got[3, 0] == (0.004688, 0.007313)


def test_key_quotes_at_the_threshold_equal_sql(spark, tmp_path):
    path = tied_turns(spark, tmp_path)
    got = sorted(tuple(r) for r in catalog.key_quotes(spark, path).collect())
    assert got == by_sql(path, "key_quotes") and len(got) == 15


def test_products_of_pairs(spark):
    """Sums for chosen pairs of rows equal those of the matrix, also where rows share nothing."""
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((30, 50)) < 0.2, rng.random((30, 50)), 0)
    dense[:, 0] += 0.1
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    row, term = np.nonzero(dense)
    a, b = np.nonzero(np.ones((30, 30)))
    got = rank._products(row, term, dense[row, term], a, b).reshape(30, 30)
    assert np.abs(got - dense @ dense.T).max() < 1e-15 and (got == got.T).all()


@pytest.mark.parametrize("words, digit, entities, want", [
    (9, False, 0, 0.5), (10, False, 0, 1.0), (14, False, 0, 1.0), (15, False, 0, 1.2), (60, False, 0, 1.2), (61, False, 0, 1.0), (10, True, 0, 1.3), (10, False, 1, 1.6), (10, False, 6, 2.0)])
def test_boost(spark, words, digit, entities, want):
    parts = [f"имя{chr(97 + i)}" for i in range(entities)] + ["x"] * (words - entities - digit) + ["7"] * digit
    df = spark.createDataFrame([(" ".join(parts), [f"имя{chr(97 + i)}" for i in range(entities)])], "s string, e array<string>")
    assert df.select(rank.boost(F.col("s"), F.col("e")).alias("b")).first()["b"] == pytest.approx(want)


def test_top_k_ties_keep_the_order(spark):
    df = spark.createDataFrame([(1, i, "s", 1.0, x) for i, x in enumerate([1.0, 3.0, 3.0, 2.0])], "doc_id int, sent_idx int, sentence string, base double, boosted double")
    assert [r["sent_idx"] for r in rank.top_k(df, 3).orderBy("rank").collect()] == [1, 2, 3]
    assert [r["sent_idx"] for r in rank.top_k_in_order(df, 2).orderBy("place").collect()] == [1, 2]


def test_empty_table(spark):
    assert rank.lex_rank(spark.createDataFrame([], "doc_id int, sent_idx int, sentence string")).count() == 0
    assert RUSSIAN.stop_words

"""Tagging against all sequences, and a model that is fitted and then read back."""

import itertools
import random

import numpy as np
import pytest

from talkloom.operators import entities, report, tagging

TAGS = tagging.BIO


def test_viterbi_by_all_sequences():
    rng = np.random.default_rng(1)
    legal = np.array([[0.0 if tagging.allowed(p, t) else -np.inf for t in TAGS] for p in TAGS])
    first = np.array([0.0 if tagging.allowed("", t) else -np.inf for t in TAGS])
    lengths = np.array([3, 0, 1, 4, 2, 4, 1])
    for whole in (False, True):  # whole numbers give ties, which go to the first tag from the end on
        scores = rng.integers(-2, 3, (lengths.sum(), 7)).astype(float) if whole else rng.normal(size=(lengths.sum(), 7))
        moves = legal + (rng.integers(-1, 2, (7, 7)) if whole else rng.normal(size=(7, 7)))
        got, at = tagging.viterbi(scores, lengths, moves, first), 0
        for n in lengths:
            def total(path, at=at):
                return sum(scores[at + i, t] for i, t in enumerate(path)) + (first[path[0]] if path else 0) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            best = min(itertools.product(range(7), repeat=int(n)), key=lambda p: (-total(p), p[::-1]))
            assert tuple(got[at : at + n]) == best
            at += n


def test_no_sequence_fits():
    scores = np.full((3, 2), 1.0)
    never = np.full((2, 2), -np.inf)
    assert tagging.viterbi(scores, np.array([1, 2]), never, np.zeros(2)).tolist() == [0, -1, -1]
    assert tagging.viterbi(np.empty((0, 2)), np.array([0, 0]), never, np.zeros(2)).tolist() == []


def spoken(seed, n=300):
    """Sentences of names, places and firms with their tags."""
    rng = random.Random(seed)
    cap = lambda: "".join(rng.choice("abdeimnorst") for _ in range(rng.randint(3, 8))).capitalize()
    rows = []
    for i in range(n):
        parts = [("We", "O")]
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["PER", "LOC", "ORG"])
            lead = {"PER": ["met", "Mr"], "LOC": ["went", "to"], "ORG": ["joined", "firm"]}[kind]
            parts += [(w, "O") for w in lead]
            parts += [(cap(), ("B-" if j == 0 else "I-") + kind) for j in range(rng.randint(1, 2))]
            parts += [("and", "O")]
        rows += [(i, j, w, t) for j, (w, t) in enumerate([*parts, (".", "O")])]
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(spoken(1), "sent_idx int, tok_idx int, token string, tag string")
    weights, moves = tagging.fit(df, ["sent_idx"])
    return tagging.model(weights, moves)


def test_fit_and_tag(spark, fitted):
    """Tags of held-out sentences, whose names are new."""
    assert all(np.isneginf(fitted.transitions[0][TAGS.index(t)]) for t in ("I-PER", "I-LOC", "I-ORG"))
    rows = spoken(2, 120)
    df = spark.createDataFrame(rows, "sent_idx int, tok_idx int, token string, tag string")
    tagged = tagging.viterbi_tagger(fitted, ["sent_idx"])(df.select("sent_idx", "tok_idx", "token"))
    got = {(r["sent_idx"], r["tok_idx"]): r["tag"] for r in tagged.collect()}
    assert len(got) == len(rows) and sum(got[i, j] == t for i, j, _, t in rows) / len(rows) > 0.97
    for (i, j), t in got.items():
        assert tagging.allowed(got.get((i, j - 1), ""), t)


def test_decode_a_table_of_scores(spark, fitted):
    df = spark.createDataFrame([(1, 2, [9.0] + 6 * [0.0]), (1, 0, [0.0, 50.0] + 5 * [0.0]), (1, 1, [0.0, 0.0, 50.0] + 4 * [0.0]), (2, 0, [0.0, 0.0, 99.0, 0.0, 0.0, 0.0, 1.0])], "k int, tok_idx int, scores array<double>")
    got = sorted((r["k"], r["tok_idx"], r["tag"]) for r in tagging.decode(df, ["k"], fitted).collect())
    assert got[:3] == [(1, 0, "B-PER"), (1, 1, "I-PER"), (1, 2, "O")] and got[3][2][0] != "I"


def test_all_kinds_reach_a_report(spark, fitted):
    text = " ".join(w for _, _, w, _ in spoken(3, 12))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    made = report.summaries(docs, tagger=tagging.viterbi_tagger(fitted, ["doc_id", "sent_idx"])).collect()
    kinds = {r["doc_id"]: {e["type"] for e in r["entities"] or ()} for r in made}
    assert kinds[1] == {"PER", "LOC", "ORG"} and not kinds.get(2) and not kinds.get(3)


def test_odd_sentences(spark, fitted):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "word " * 30000), (5, "Ünïcode 日本 🙂 !")], "k int, sentence string")
    got = {r["k"]: (len(r["tokens"]), len(r["tags"])) for r in tagging.tag_sentences(df, ["k"], fitted).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (30000, 30000), 5: (got[5][0], got[5][0])}
    assert entities.spans(tagging.exploded(tagging.tag_sentences(df.limit(0), ["k"], fitted), ["k"]), ["k"]).count() == 0


def test_decoding_in_parts():
    """A batch is decoded some tokens at a time, whatever it holds, and each sentence gets the tags that it gets alone."""
    import pyarrow as pa

    words = [["we", "met", "Ann"] * (i % 4) for i in range(50)] + [None, ["Ann"] * (tagging.TOKENS + 5), [], ["met"] * (tagging.TOKENS - 1), ["Ann"]]
    m, seen = tagging.Model(TAGS, {}, [[0.0 if tagging.allowed(p, t) else -np.inf for t in TAGS] for p in TAGS], [0.0 if tagging.allowed("", t) else -np.inf for t in TAGS]), []

    def score(tokens):
        seen.append(len(tokens))
        return np.array([[float(t == ("B-PER" if w == "Ann" else "O")) for t in TAGS] for w in tokens.to_pylist()]).reshape(-1, len(TAGS))

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words))), pa.array(words, pa.list_(pa.string()))], ["id", "tokens"])
    got = [r for b in tagging._in_parts(iter([batch]), 1, 2, score, m, ["id", "tokens", "tags"]) for r in b.to_pylist()]
    assert [r["tags"] for r in got] == [["B-PER" if w == "Ann" else "O" for w in x or ()] for x in words]
    assert sum(seen) == sum(len(x or ()) for x in words) and sorted(seen)[-2] <= tagging.TOKENS < max(seen) == tagging.TOKENS + 5

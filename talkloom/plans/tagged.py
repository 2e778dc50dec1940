"""Queries over tags that a model of fixed weights gives by Viterbi decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicons import TEST
from ..operators import entities as ent
from ..operators import tagging
from .tables import read

KEYS = ["doc_id", "sent_idx"]
#: feature: weight by tag.  Quarters, so that sums are exact in any order.
WEIGHTS = {
    "*": {"O": 1.0, "B-PER": -0.5, "B-LOC": -0.75, "B-ORG": -0.75, "I-PER": -0.5, "I-LOC": -0.5, "I-ORG": -0.5},
    "s=EN_Xx": {"O": -1.0, "B-PER": 1.5, "I-PER": 1.5, "B-LOC": 1.25, "I-LOC": 1.25, "B-ORG": 1.0, "I-ORG": 1.25},
    "s=EN_xx": {"I-ORG": -0.25, "B-LOC": -0.5},
    "s=NUM": {"I-ORG": 1.5, "I-LOC": 0.5},
    "p=<>": {"O": 1.5},
    "p=.": {"O": 0.75, "B-PER": 0.25, "B-ORG": 0.25},
    "ns=EN_Xx": {"B-PER": 0.5, "B-ORG": 0.25},
    "ps=EN_Xx": {"I-PER": 0.5, "I-LOC": 0.25, "I-ORG": 0.5},
    "n=,": {"B-LOC": 0.75},
    "n=.": {"I-PER": 0.5, "B-ORG": -0.25},
    "e=ion": {"B-ORG": 2.25, "I-ORG": 2.0},
    "e=ing": {"B-LOC": 2.25, "I-LOC": 1.5},
    "e=ent": {"B-LOC": 1.75, "O": -0.25},
    "e=the": {"B-PER": 1.0},
    "w=of": {"I-ORG": 1.75},
    "w=de": {"I-LOC": 1.75, "I-PER": 1.5},
}
BONUS = {("B-PER", "I-PER"): 0.5, ("B-ORG", "I-ORG"): 0.25, ("I-PER", "B-PER"): -1.0, ("O", "B-ORG"): 0.25, ("B-LOC", "B-PER"): -0.5, ("I-LOC", "I-LOC"): -0.75}
TRANSITIONS = [(p, t, BONUS.get((p, t), 0.0)) for p, t, _ in tagging.bio_transitions()]


def _model(spark) -> tagging.Model:
    weights = spark.createDataFrame([(f, t, w) for f, each in WEIGHTS.items() for t, w in each.items()], "feature string, tag string, weight double")
    return tagging.model(weights, spark.createDataFrame(TRANSITIONS, "prev string, tag string, score double"))


def _sentences(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_idx"), F.col("text").alias("sentence"))


def viterbi_tags(spark, sf_dir):
    """Tokens with their tags."""
    return tagging.exploded(tagging.tag_sentences(_sentences(spark, sf_dir), KEYS, _model(spark)), KEYS)


def tagged_entities(spark, sf_dir):
    """People, places and organisations of each conversation, counted."""
    found = ent.spans(tagging.exploded(tagging.tag_sentences(_sentences(spark, sf_dir), KEYS, _model(spark)), KEYS), KEYS)
    return ent.entity_counts(found, pack=TEST).select("doc_id", "type", "text", "count", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (viterbi_tags, tagged_entities)}


def oracles(shaped: str) -> dict[str, str]:
    """shaped: SQL of the tokens and their shapes, a WITH clause that ends with `shaped`."""
    weights = ", ".join(f"('{f}', '{t}', {w}::DOUBLE)" for f, each in WEIGHTS.items() for t, w in each.items())
    steps = ", ".join(f"('{p}', '{t}', {s}::DOUBLE)" for p, t, s in TRANSITIONS)
    tags = ", ".join(f"({i}, '{t}')" for i, t in enumerate(tagging.BIO))
    near = "OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx)"
    tagged = shaped.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
wt(feature, tag, weight) AS (VALUES {weights}), tr(prev, tag, score) AS (VALUES {steps}), tg(k, tag) AS (VALUES {tags}),
ft AS (SELECT doc_id, sent_idx, tok_idx, token, ['*', 'w=' || lower(token), 's=' || shape, 'e=' || right(lower(token), 3), 'p=' || coalesce(lag(lower(token)) {near}, '<>'), 'n=' || coalesce(lead(lower(token)) {near}, '<>'),
  'ps=' || coalesce(lag(shape) {near}, '<>'), 'ns=' || coalesce(lead(shape) {near}, '<>')] AS fs FROM shaped),
fx AS (SELECT doc_id, sent_idx, tok_idx, unnest(fs) AS feature FROM ft),
sm AS (SELECT doc_id, sent_idx, tok_idx, tag, sum(weight) AS s FROM fx JOIN wt USING (feature) GROUP BY ALL),
em AS (SELECT ft.doc_id, ft.sent_idx, ft.tok_idx, tg.k, tg.tag, coalesce(s, 0) AS score FROM ft CROSS JOIN tg LEFT JOIN sm ON sm.doc_id = ft.doc_id AND sm.sent_idx = ft.sent_idx AND sm.tok_idx = ft.tok_idx AND sm.tag = tg.tag),
vt AS (
  SELECT doc_id, sent_idx, tok_idx, k, em.tag, em.score + tr.score AS alpha, em.tag AS path FROM em JOIN tr ON tr.prev = '' AND tr.tag = em.tag WHERE tok_idx = 0
  UNION ALL
  SELECT doc_id, sent_idx, tok_idx, k, tag, best + score, path || ' ' || tag FROM (
    SELECT e.doc_id, e.sent_idx, e.tok_idx, e.k, e.tag, any_value(e.score) AS score, max(v.alpha + tr.score) AS best, arg_max(v.path, (v.alpha + tr.score) * 1000 - v.k) AS path
    FROM vt v JOIN em e ON e.doc_id = v.doc_id AND e.sent_idx = v.sent_idx AND e.tok_idx = v.tok_idx + 1 JOIN tr ON tr.prev = v.tag AND tr.tag = e.tag GROUP BY e.doc_id, e.sent_idx, e.tok_idx, e.k, e.tag)),
la AS (SELECT doc_id, sent_idx, max(tok_idx) AS tok_idx FROM ft GROUP BY ALL),
bp AS (SELECT doc_id, sent_idx, string_split(arg_max(path, alpha * 1000 - k), ' ') AS tags FROM vt JOIN la USING (doc_id, sent_idx, tok_idx) GROUP BY ALL),
vg AS (SELECT doc_id, sent_idx, tok_idx, token, tags[tok_idx + 1] AS tag FROM ft JOIN bp USING (doc_id, sent_idx))
"""
    return {
        "viterbi_tags": tagged + "SELECT doc_id, sent_idx, tok_idx, token, tag FROM vg",
        "tagged_entities": tagged + """,
ru AS (SELECT *, sum(CASE WHEN tag LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sent_idx ORDER BY tok_idx) AS run FROM vg),
sp AS (SELECT doc_id, substr(any_value(tag), 3) AS type, string_agg(token, ' ' ORDER BY tok_idx) AS text FROM ru WHERE tag <> 'O' GROUP BY doc_id, sent_idx, run),
kp AS (SELECT *, lower(text) AS t FROM sp),
ct AS (SELECT doc_id, type, text, count(*) AS n FROM kp
  WHERE NOT (length(t) <= 2 OR t IN ('the', 'and') OR regexp_full_match(t, '[aeiouy]+(-[aeiouy]+)*') OR (type = 'PER' AND NOT contains(t, ' ') AND length(t) < 4)) GROUP BY ALL)
SELECT doc_id, type, text, n AS count, row_number() OVER (PARTITION BY doc_id, type ORDER BY n DESC, text) AS rank FROM ct""",
    }

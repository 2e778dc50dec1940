"""Queries over one key that holds the whole table, spread over ranges, texts spread over pieces, times over cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract
from ..functions.lexicons import TEST
from ..operators import intervals, overlap, pieces, transcript
from .tables import read, samples, turns

PARTS = 64
PIECE = 1500  #: characters; most documents have more, so that their sentences are put together from pieces


def spread_runs(spark, sf_dir):
    """Runs of events of all users together."""
    e = samples(spark, sf_dir).select(F.lit(0).cast("long").alias("key"), (F.unix_millis("ts") / 1000.0).alias("start_s")).withColumn("end_s", F.col("start_s") + 60.0)
    out = intervals.merged_intervals(e, ["key"], pause=600.0, least=90.0, parts=PARTS)
    return out.select("run", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "n")


def _chain(spark, sf_dir):
    """All conversations as one session; times stay those of the conversation."""
    order = F.col("session_id") * 1000 + F.col("seg_idx")
    return turns(spark, sf_dir).withColumn("seg_idx", order).withColumn("session_id", F.lit(0).cast("long"))


def spread_turns(spark, sf_dir):
    t = transcript.merged_turns(_chain(spark, sf_dir), parts=PARTS)
    return t.select(F.col("turn").cast("long").alias("turn"), "speaker_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.col("n_segments").cast("long").alias("n_segments"), "text")


def spread_chunks(spark, sf_dir):
    """Four turns a chunk, and speakers numbered through all chunks."""
    s = _chain(spark, sf_dir).withColumn("chunk_idx", F.expr("seg_idx div 4"))
    chunks = s.select("session_id", "chunk_idx").distinct().withColumn("chunk_start_ms", F.col("chunk_idx") * 1000)
    return transcript.stitched_chunks(s, chunks, parts=PARTS).select("seg_idx", "speaker_id", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


def long_text_sentences(spark, sf_dir):
    """Sentences of the documents, put together from pieces."""
    return pieces.long_text_sentences(read(spark, sf_dir, "documents"), pack=TEST, piece=PIECE)


def _intervals(spark, sf_dir):
    """Turns as a recogniser of speakers might give them, off by some time; a fifth turn is not heard, and some
    conversations have a third speaker throughout."""
    t = turns(spark, sf_dir).select("session_id", "seg_idx", "speaker_id", F.col("start_ms") - 700, F.col("end_ms") + F.col("seg_idx") % 3 * 600).toDF("session_id", "seg_idx", "speaker_id", "start_ms", "end_ms")
    whole = t.where("session_id % 4 = 0").groupBy("session_id").agg(F.lit(2).alias("speaker_id"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return t.where("seg_idx % 5 <> 4").drop("seg_idx").unionByName(whole)


def words_by_speaker(spark, sf_dir):
    """Each word's speaker by time."""
    words = transcript.even_words(turns(spark, sf_dir), ["session_id", "seg_idx"])
    out = overlap.speakers_by_time(words, _intervals(spark, sf_dir), ["session_id"], ["seg_idx", "word_idx"], default=-1)
    return out.select("session_id", "seg_idx", F.col("word_idx").cast("long").alias("word_idx"), "text", F.col("speaker_id").cast("long").alias("speaker_id"))


def lexicon_hits(spark, sf_dir):
    """How many documents hold each longer word of the conversations."""
    spoken = read(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 9")
    found = extract.contained_in(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", spoken)
    return found.groupBy("word").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (spread_runs, spread_turns, spread_chunks, long_text_sentences, words_by_speaker, lexicon_hits)}


def oracles(turn_sql: str, merged_sql: str, word_sql: str, sentences: str) -> dict[str, str]:
    chain = ", chain AS (SELECT * REPLACE (0 AS session_id, session_id * 1000 + seg_idx AS seg_idx) FROM seg)"
    return {
        "long_text_sentences": sentences,
        "words_by_speaker": word_sql + """,
iv AS (SELECT session_id, speaker_id, start_ms - 700 AS a, end_ms + seg_idx % 3 * 600 AS b, seg_idx FROM seg),
ix AS (SELECT session_id, speaker_id, a, b FROM iv WHERE seg_idx % 5 <> 4 UNION ALL SELECT session_id, 2, min(a), max(b) FROM iv WHERE session_id % 4 = 0 GROUP BY ALL),
wt AS (SELECT session_id, seg_idx, word_idx, word, start_ms + word_idx * per AS a, start_ms + (word_idx + 1) * per AS b FROM wv),
oc AS (SELECT wt.session_id, seg_idx, word_idx, speaker_id, sum(least(wt.b, ix.b) - greatest(wt.a, ix.a)) AS ms FROM wt JOIN ix ON wt.session_id = ix.session_id AND wt.a < ix.b AND ix.a < wt.b GROUP BY ALL),
bs AS (SELECT session_id, seg_idx, word_idx, speaker_id FROM oc QUALIFY row_number() OVER (PARTITION BY session_id, seg_idx, word_idx ORDER BY ms DESC, speaker_id) = 1)
SELECT session_id, seg_idx, word_idx::BIGINT AS word_idx, word AS text, coalesce(bs.speaker_id, -1)::BIGINT AS speaker_id FROM wt LEFT JOIN bs USING (session_id, seg_idx, word_idx)""",
        "lexicon_hits": """WITH w AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM conversations), l AS (SELECT word FROM w WHERE length(word) >= 9)
SELECT word, count(*) AS n_docs FROM l JOIN (SELECT lower(text) AS t FROM documents) d ON contains(d.t, l.word) GROUP BY ALL""",
        "spread_runs": """WITH e AS (SELECT (epoch_us(ts) // 1000) / 1000.0 AS a, (epoch_us(ts) // 1000) / 1000.0 + 60 AS b FROM events),
m AS (SELECT *, CASE WHEN a - max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 600 THEN 0 ELSE 1 END AS fresh FROM e),
r AS (SELECT *, sum(fresh) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS run FROM m)
SELECT run, round(min(a), 3) AS start_s, round(max(b), 3) AS end_s, count(*) AS n FROM r GROUP BY run HAVING max(b) - min(a) >= 90""",
        "spread_turns": merged_sql.replace("\nmk AS", chain[1:] + ",\nmk AS", 1).replace("FROM seg WINDOW", "FROM chain WINDOW")
        + "SELECT run::BIGINT AS turn, speaker_id, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, n_segments, text FROM mg",
        "spread_chunks": turn_sql + chain + """, c AS (SELECT *, seg_idx // 4 AS chunk FROM chain), k AS (SELECT chunk, count(DISTINCT speaker_id) AS k FROM c GROUP BY ALL),
s AS (SELECT *, coalesce(sum(k) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM k)
SELECT seg_idx, (speaker_id + shift)::BIGINT AS speaker_id, (start_ms + chunk * 1000)::BIGINT AS start_ms, (end_ms + chunk * 1000)::BIGINT AS end_ms FROM c JOIN s USING (chunk)""",
    }

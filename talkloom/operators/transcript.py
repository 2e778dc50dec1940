"""Transcript tables: segments and words, confidence, speakers, merged turns and stitched chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

PREFIX = "Спикер "


def segments_of(sessions: DataFrame) -> DataFrame:
    """session_id, seg_idx, speaker_id, start_ms, end_ms, words of the sessions of sources.sessions."""
    rows = sessions.select(F.col("id").alias("session_id"), F.posexplode("transcript.segments").alias("seg_idx", "s"))
    return rows.select("session_id", "seg_idx", F.col("s.speakerId").alias("speaker_id"), F.col("s.startMs").alias("start_ms"), F.col("s.endMs").alias("end_ms"), F.col("s.words").alias("words"))


def words_of(segments: DataFrame) -> DataFrame:
    rows = segments.select("session_id", "seg_idx", F.posexplode("words").alias("word_idx", "w"))
    return rows.select("session_id", "seg_idx", "word_idx", F.col("w.text").alias("text"), F.col("w.startMs").alias("start_ms"), F.col("w.endMs").alias("end_ms"), F.col("w.confidence").cast("float").alias("confidence"))


def participants_of(sessions: DataFrame) -> DataFrame:
    """session_id, speaker_id, name; keys that are no integers and blank names are dropped."""
    rows = sessions.select(F.col("id").alias("session_id"), F.explode("participants").alias("k", "v"))
    rows = rows.select("session_id", F.expr("try_cast(k AS int)").alias("speaker_id"), clean_name(F.col("v")).alias("name"))
    return rows.where("speaker_id IS NOT NULL AND name IS NOT NULL")


def clean_name(name: Column) -> Column:
    return F.nullif(F.trim(name), F.lit(""))


def confidence_level(confidence: Column) -> Column:
    c = confidence.cast("float")
    return F.when(c >= F.lit(0.85).cast("float"), "HIGH").when(c >= F.lit(0.65).cast("float"), "MEDIUM").otherwise("LOW")


def proxy_confidence(word: Column) -> Column:
    """Confidence by the length of the word, where the recogniser gives none."""
    n = F.length(word)
    return F.when(n >= 5, 0.92).when(n >= 3, 0.78).when(n >= 2, 0.65).otherwise(0.45).cast("float")


def segment_text(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def plain_documents(segments: DataFrame, key: str = "session_id", order: str = "seg_idx", text: str = "text") -> DataFrame:
    """key, text: the segment texts of a session joined by a blank, in order."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return segments.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"))


def useful_segments(segments: DataFrame, least_ms: int = 200) -> DataFrame:
    """Without segments that are too short, end before they start, or have no words."""
    return segments.where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") >= least_ms) & (F.size("words") > 0))


def even_words(segments: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Words of a segment with even times: start + k * (duration div n)."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    rows = segments.select(*keys, "start_ms", "end_ms", words.alias("_w"))
    rows = rows.select(*keys, "start_ms", F.expr("(end_ms - start_ms) div greatest(size(_w), 1)").alias("_per"), F.posexplode("_w").alias("word_idx", "text"))
    start = F.col("start_ms") + F.col("word_idx") * F.col("_per")
    return rows.select(*keys, "word_idx", "text", start.alias("start_ms"), (start + F.col("_per")).alias("end_ms"), proxy_confidence(F.col("text")).alias("confidence"))


def segment_confidence(words: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Least and mean confidence of each segment; 1.0 where it has no words."""
    stats = words.groupBy(*keys).agg(F.min("confidence").alias("a"), F.avg("confidence").alias("b"))
    return segments.select(*keys).join(stats, keys, "left").select(*keys, F.coalesce("a", F.lit(1.0)).cast("double").alias("min_confidence"), F.coalesce("b", F.lit(1.0)).alias("avg_confidence"))


def transcript_stats(words: DataFrame, segments: DataFrame, key: str = "session_id") -> DataFrame:
    level = confidence_level(F.col("confidence"))
    of_words = words.groupBy(key).agg(F.count("*").alias("n_words"), F.count_if(level == "LOW").alias("n_low"), F.count_if(level == "MEDIUM").alias("n_medium"))
    of_segments = segments.groupBy(key).agg(F.count("*").alias("n_segments"), F.count_distinct("speaker_id").alias("n_speakers"), F.sort_array(F.collect_set("speaker_id")).alias("speakers"))
    return of_segments.join(of_words, key, "left").na.fill(0, ["n_words", "n_low", "n_medium"])


def speaker_labels(segments: DataFrame, participants: DataFrame, key: str = "session_id", prefix: str = PREFIX) -> DataFrame:
    """Adds speaker: the given name, or the prefix and the number counted from 1.  Of several names of one
    speaker the first in order counts."""
    names = participants.groupBy(key, "speaker_id").agg(F.min(clean_name(F.col("name"))).alias("_name"))
    named = segments.join(names, [key, "speaker_id"], "left")
    return named.withColumn("speaker", F.coalesce("_name", F.concat(F.lit(prefix), (F.col("speaker_id") + 1).cast("string")))).drop("_name")


def all_speakers(known: Column, edited: Column) -> Column:
    both = F.array_sort(F.array_union(known, edited))
    return F.when(F.size(both) == 0, F.array(F.lit(0))).otherwise(both)


def merged_turns(segments: DataFrame, key: str = "session_id", order: str = "seg_idx", most_gap_ms: int = 2000, text: str = "text", parts: int | None = None) -> DataFrame:
    """key, turn, speaker_id, start_ms, end_ms, n_segments, text: neighbours of one speaker with a gap of
    0 to most_gap_ms are one turn.  An overlap does not merge.  parts: spread each key over so many ranges of `order`."""
    follows = lambda who, end: F.when((F.col("speaker_id") == who) & (F.col("start_ms") - end).between(0, most_gap_ms), 0).otherwise(1)
    if parts:
        rows = scan.previous(scan.laid_out(segments, [key], [order], parts), [key], [order], ["speaker_id", "end_ms"])
        runs = scan.running_sum(rows.withColumn("_new", follows(F.col("_before.speaker_id"), F.col("_before.end_ms"))), [key], [order], F.col("_new"), "turn").withColumn("turn", F.col("turn") - 1)
    else:
        w = Window.partitionBy(key).orderBy(order)
        runs = segments.withColumn("_new", follows(F.lag("speaker_id").over(w), F.lag("end_ms").over(w))).withColumn("turn", F.sum("_new").over(w) - 1)
    parts_ = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("end_ms").alias("e"), F.col(text).alias("t"))))
    out = runs.groupBy(key, "turn").agg(F.first("speaker_id").alias("speaker_id"), F.min("start_ms").alias("_lo"), F.min_by("start_ms", order).alias("start_ms"), parts_.alias("_p"))
    return out.select(key, "turn", "speaker_id", "start_ms", F.element_at("_p", -1)["e"].alias("end_ms"), F.size("_p").alias("n_segments"), F.array_join(F.transform("_p", lambda x: x["t"]), " ").alias("text"))


def stitched_chunks(segments: DataFrame, chunks: DataFrame, key: str = "session_id", dense: bool = False, parts: int | None = None) -> DataFrame:
    """Segments of chunks on one time line: chunk_start_ms is added to times, and the count of distinct
    speakers of earlier chunks to ids.  dense numbers the ids of a chunk 0..k-1 first, so none collide.  parts: spread
    each key's chunks over so many ranges."""
    if dense:
        segments = segments.withColumn("speaker_id", F.dense_rank().over(Window.partitionBy(key, "chunk_idx").orderBy("speaker_id")) - 1)
    n = segments.groupBy(key, "chunk_idx").agg(F.count_distinct("speaker_id").alias("_k"))
    shift = chunks.select(key, "chunk_idx", "chunk_start_ms").join(n, [key, "chunk_idx"], "left")
    if parts:
        shift = scan.running_sum(scan.laid_out(shift, [key], ["chunk_idx"], parts), [key], ["chunk_idx"], F.col("_k"), "_shift", own=False).drop("_k", scan.PART)
    else:
        before = Window.partitionBy(key).orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
        shift = shift.withColumn("_shift", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    return segments.join(shift, [key, "chunk_idx"]).select(
        key, "chunk_idx", "seg_idx", (F.col("speaker_id") + F.col("_shift")).cast("long").alias("speaker_id"),
        (F.col("start_ms") + F.col("chunk_start_ms")).alias("start_ms"), (F.col("end_ms") + F.col("chunk_start_ms")).alias("end_ms"))


def with_default_interval(recordings: DataFrame, intervals: DataFrame, key: str = "session_id") -> DataFrame:
    """A recording without intervals is one segment of speaker 0 over its whole duration."""
    both = recordings.select(key, "duration_ms").join(intervals.select(key, "speaker_id", "start_ms", "end_ms"), key, "left")
    return both.select(key, F.coalesce("speaker_id", F.lit(0)).alias("speaker_id"), F.coalesce("start_ms", F.lit(0).cast("long")).alias("start_ms"), F.coalesce("end_ms", "duration_ms").alias("end_ms"))


def audio_flag(sessions: DataFrame, inventory: DataFrame, name: str = "audioFileName") -> DataFrame:
    """Adds has_audio: a file of that name is there and not empty."""
    files = inventory.where("length > 0").select(F.col("filename").alias("_f")).distinct()
    return sessions.join(files, F.col(name) == F.col("_f"), "left").withColumn("has_audio", F.col("_f").isNotNull()).drop("_f")

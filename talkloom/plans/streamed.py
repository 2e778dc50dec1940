"""Queries that run the given tables through streams, and read what these have written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, store
from ..sources import sessions as src
from ..sources.shared import shared_dir, stored
from ..streaming import streams
from .tables import samples

#: Parts of the table that arrive one after another, each a run of the stream that goes on from the one before.
ARRIVALS = 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def arrived(spark: SparkSession, df: DataFrame, stream, name: str) -> DataFrame:
    """What `stream`, a function of a streaming DataFrame of samples, writes as they arrive in the order of time.  A last
    sample of no key in the far future lets the watermark pass all others."""
    own = spark.newSession()  # its settings are its own
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", max(8, 2 * spark.sparkContext.defaultParallelism))
    into, out, checkpoint = (_folder(spark, f"{name}-{x}") for x in ("in", "out", "checkpoint"))
    df = stored(df, f"{name}-rows")
    first, last = (x.timestamp() for x in df.agg(F.min("ts"), F.max("ts")).first() or (None, None)) if not df.isEmpty() else (0.0, 0.0)
    part = F.least(F.floor((F.unix_micros("ts") / 1e6 - first) / ((last - first) / ARRIVALS + 1e-6)), F.lit(ARRIVALS - 1))
    end = own.range(1).select(F.lit(None).cast("long").alias("key"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("value"))
    for i in range(ARRIVALS + 1):
        (end if i == ARRIVALS else own.read.schema(df.schema).parquet(df.inputFiles()[0].rsplit("/", 1)[0]).where(part == i)).write.mode("append").parquet(into)
        live = own.readStream.schema(df.schema).parquet(into)
        stream(live).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    schema = stream(own.readStream.schema(df.schema).parquet(into)).schema
    return spark.read.schema(schema).parquet(out)


def stream_levels(spark, sf_dir):
    out = arrived(spark, samples(spark, sf_dir), lambda s: streams.level_meter(s, "key", "1 day", "0 seconds", clip=False), "levels")
    return out.where("key is not null").select("key", F.date_format("start", "yyyy-MM-dd").alias("day"), F.round("level", 4).alias("level"))


def stream_runs(spark, sf_dir):
    out = arrived(spark, samples(spark, sf_dir), lambda s: streams.activity_runs(s, "key", "1 hour", "0 seconds"), "runs")
    return out.where("key is not null").select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def stream_resampled(spark, sf_dir):
    """Samples on a grid of six hours, with the state of each series dropped once it has ended."""
    out = arrived(spark, samples(spark, sf_dir), lambda s: streams.resampled_stream(s, "key", 21600, gap_seconds=400 * 86400), "resampled")
    return out.where("key is not null").select("key", F.unix_millis("ts").alias("ts_ms"), F.round("value", 4).alias("value"))


def streamed_sessions(spark, sf_dir):
    """Sessions as files of their own, among others, found by name, streamed into the bucketed store, some deleted and some
    put again, compacted, and listed."""
    from .catalog import _sessions

    made = stored(_sessions(spark, sf_dir), "session-rows")
    into, path, checkpoint = (_folder(spark, f"store-{x}") for x in ("in", "records", "checkpoint"))
    number = (F.col("createdAt") / 1000).cast("long")
    text = F.to_json(F.struct(*made.columns)).cast("binary")
    for i in range(2):  # the second half comes later
        part = made.where(number % 2 == i)
        files.write_files(part.select(F.concat(F.lit("session_"), F.col("id"), F.lit(".json")).alias("name"), text.alias("content")), into)
        files.write_files(part.where(number % 5 == 0).select(F.concat(F.lit("note_"), F.col("id"), F.lit(".json")).alias("name"), text.alias("content")), into)
        files.write_files(part.where(number % 7 == 0).select(F.concat(F.lit("session_broken_"), F.col("id"), F.lit(".json")).alias("name"), F.lit(b"{cut").alias("content")), into)
        store.stream_into(src.session_stream(spark, into), path, checkpoint)
    kept = store.current(spark, path)
    store.delete(made.where(number % 3 == 1), kept, path, 1000)
    store.put(stored(kept.where((F.col("createdAt") / 1000).cast("long") % 6 == 1).withColumn("createdAt", F.lit(7).cast("long")), "store-again"), path, 1001)
    store.compact(spark, path, 1001)
    return src.history(store.current(spark, path)).select("id", "createdAt", "title", "n_segments", "n_words", F.col("duration_ms").alias("total_ms"))


QUERIES = {f.__name__: f for f in (stream_levels, stream_runs, stream_resampled, streamed_sessions)}


def oracles(levels: str, resampled: str, word_sql: str) -> dict[str, str]:
    return {
        "stream_levels": levels,
        "stream_resampled": resampled,
        "stream_runs": """WITH e AS (SELECT user_id AS key, epoch_us(ts) AS t FROM events),
m AS (SELECT *, CASE WHEN t - lag(t) OVER w < 3600000000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY key ORDER BY t)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT key, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM r GROUP BY key, run""",
        "streamed_sessions": word_sql + """, a AS (SELECT session_id, count(*) AS n_words FROM wv GROUP BY ALL), b AS (SELECT session_id, count(*) AS n_segments, max(end_ms)::BIGINT AS total_ms FROM seg GROUP BY ALL)
SELECT 'c' || session_id AS id, (CASE WHEN session_id % 6 = 1 THEN 7 ELSE session_id * 1000 END)::BIGINT AS "createdAt",
'Conversation ' || session_id AS title, n_segments, coalesce(n_words, 0) AS n_words, total_ms FROM b LEFT JOIN a USING (session_id) WHERE session_id % 3 <> 1 OR session_id % 6 = 1""",
    }

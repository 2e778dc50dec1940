"""Session files, recordings and reports: reading, writing, listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened, write_files

WORD = "struct<text:string,startMs:bigint,endMs:bigint,confidence:float>"
SEGMENT = f"struct<speakerId:int,startMs:bigint,endMs:bigint,words:array<{WORD}>>"
SESSION = (
    "id STRING, createdAt BIGINT, audioFileName STRING, "
    "metadata STRUCT<title: STRING, location: STRING, auditorName: STRING, date: BIGINT, notes: STRING>, participants MAP<STRING, STRING>, "
    f"transcript STRUCT<totalDurationMs: BIGINT, recordedAt: BIGINT, sourceWavPath: STRING, numSpeakers: INT, segments: ARRAY<{SEGMENT}>>, _corrupt_record STRING")

#: Characters that Spark writes as % and two digits in the name of a partition's folder.
SPECIAL = "%\"#'*/:=?\\{[]^\x7f" + "".join(map(chr, range(1, 32)))


def read_sessions(spark: SparkSession, path: str, complete: bool = True) -> DataFrame:
    """All sessions session_*.json of a folder; files that are no JSON, or lack what is required, are skipped.
    complete: everything a session needs; else what a listing needs."""
    raw = spark.read.schema(SESSION).option("multiLine", True).option("pathGlobFilter", "session_*.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return valid(raw, complete)


def valid(raw: DataFrame, complete: bool = True) -> DataFrame:
    ok = F.col("_corrupt_record").isNull() & F.col("id").isNotNull() & F.col("metadata").isNotNull() & F.col("transcript.segments").isNotNull()
    ok = ok & F.forall("transcript.segments", lambda s: s["words"].isNotNull())
    if complete:
        ok = ok & F.col("participants").isNotNull() & F.col("transcript.totalDurationMs").isNotNull()
        ok = ok & F.forall("transcript.segments", lambda s: s["speakerId"].isNotNull() & s["startMs"].isNotNull() & s["endMs"].isNotNull() & F.forall(
            s["words"], lambda w: w["text"].isNotNull() & w["startMs"].isNotNull() & w["endMs"].isNotNull() & w["confidence"].isNotNull()))
    m, t = F.col("metadata"), F.col("transcript")
    text = lambda c: F.coalesce(c, F.lit(""))
    return raw.where(ok).select(
        "id", F.coalesce("createdAt", F.lit(0).cast("long")).alias("createdAt"), F.nullif(F.trim("audioFileName"), F.lit("")).alias("audioFileName"),
        F.struct(text(m["title"]).alias("title"), text(m["location"]).alias("location"), text(m["auditorName"]).alias("auditorName"), m["date"].alias("date"), text(m["notes"]).alias("notes")).alias("metadata"),
        "participants",
        F.struct(F.coalesce(t["totalDurationMs"], F.lit(0).cast("long")).alias("totalDurationMs"), F.coalesce(t["recordedAt"], F.lit(0).cast("long")).alias("recordedAt"),
                 text(t["sourceWavPath"]).alias("sourceWavPath"), F.coalesce(t["numSpeakers"], F.lit(0)).alias("numSpeakers"), t["segments"].alias("segments")).alias("transcript"))


def load(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """The session of that id, or no row."""
    return read_sessions(spark, path).where(F.col("id") == session_id)


def upserted(stored: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored sessions with new ones added; those of the same id are replaced."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def without(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(key), key, "left_anti")


def _folder(column: str, value: Column) -> Column:
    """The name of a partition's folder, as Spark writes it."""
    safe = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), SPECIAL, value)
    return F.concat(F.lit(f"{column}="), F.when(value != "", safe).otherwise("__HIVE_DEFAULT_PARTITION__"))


def write_sessions(sessions: DataFrame, path: str) -> None:
    """One folder per id with a file of JSON lines, so that a write replaces just the ids it brings.  The files go through the
    sink of files: a write of partitions moves each folder in the driver, one after another."""
    lines = sessions.select(_folder("session", F.col("id")).alias("folder"), F.to_json(F.struct(*sessions.columns)).alias("line"))
    each = lines.groupBy("folder").agg(F.concat(F.array_join(F.collect_list("line"), "\n"), F.lit("\n")).alias("body"))
    write_files(each.select(F.concat("folder", F.lit("/part-0.json")).alias("name"), F.col("body").cast("binary").alias("content")), path)


def read_written(spark: SparkSession, path: str, complete: bool = True) -> DataFrame:
    """What write_sessions wrote; one line a session."""
    return valid(spark.read.schema(SESSION).option("columnNameOfCorruptRecord", "_corrupt_record").json(path), complete)


def history(sessions: DataFrame) -> DataFrame:
    """One row per session for a list, newest first."""
    words = F.aggregate("transcript.segments", F.lit(0), lambda a, s: a + F.size(s["words"]))
    rows = sessions.select("id", "createdAt", F.col("metadata.title").alias("title"), F.col("metadata.location").alias("location"), F.size("transcript.segments").cast("long").alias("n_segments"),
                           words.cast("long").alias("n_words"), F.col("transcript.totalDurationMs").alias("duration_ms"), F.col("audioFileName").isNotNull().alias("names_audio"))
    return rows.orderBy(F.desc("createdAt"), "id")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def _little(content: Column, at: int, n: int) -> Column:
    """An unsigned little-endian number of n bytes."""
    return F.conv(F.concat(*[F.hex(F.substring(content, at + i, 1)) for i in range(n, 0, -1)]), 16, 10).cast("long")


def recordings(binary: DataFrame) -> DataFrame:
    """filename, sample_rate, channels, duration_ms from the 44-byte header; files that are shorter go.  binary: whole files,
    of `files`; `sources.files.read_recordings` reads the headers alone."""
    c = F.col("content")
    head = binary.where(F.col("length") >= 44).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length", _little(c, 24, 4).alias("sample_rate"), _little(c, 22, 2).alias("channels"))
    return head.where("sample_rate > 0 AND channels > 0").select("filename", "length", "sample_rate", "channels", F.expr("((length - 44) * 1000) div (sample_rate * channels * 2)").alias("duration_ms"))


def write_reports(reports: DataFrame, path: str) -> None:
    """reports: name, body.  A folder per report name with its text, a file a row.  Replaces what is in the folder.  The files go
    through the sink of files, as Hadoop's local file system starts processes for each folder and file."""
    system, root = opened(path)
    system.create_dir(root, recursive=True)
    system.delete_dir_contents(root)
    file = F.concat(_folder("name", F.col("name")), F.lit("/part-"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    write_files(reports.select(file.alias("name"), F.concat(F.coalesce("body", F.lit("")), F.lit("\n")).cast("binary").alias("content")), path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """name, body of what write_reports wrote; a report ends with a line feed."""
    return spark.read.schema("value string, name string").text(path, wholetext=True).select("name", F.col("value").alias("body"))


def session_stream(spark: SparkSession, path: str) -> DataFrame:
    """New session files as a stream."""
    raw = spark.readStream.schema(SESSION).option("multiLine", True).option("pathGlobFilter", "session_*.json").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return valid(raw)

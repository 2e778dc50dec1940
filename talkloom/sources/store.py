"""A store of records by id, in hashed buckets: upserts, deletions and compaction without a file a record.

A change is a numbered set of rows (sequence): rows to put, or ids to delete.  It is written as folders
bucket=b/sequence=n by dynamic partition overwrite, so writing the same number again replaces what an earlier, perhaps broken,
attempt left: a stream's batch that is run twice counts once.  Reading takes, of each id, the row of the highest sequence.
Compaction writes the state up to a sequence as that sequence, one file a bucket, and then removes the earlier folders; in
between readers see the same state.  A deletion outlives one compaction, as long as an older row may be there.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened
from .shared import stored

BUCKETS = 16


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(BUCKETS, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "sequence").parquet(path)


def put(records: DataFrame, path: str, sequence: int, key: str = "id") -> None:
    """Records by id; of several with one id in a set, one is taken (the largest by its columns, as far as they can be compared)."""
    others = [f.name for f in records.schema if "map<" not in f.dataType.simpleString()]
    one = records.groupBy(key).agg(F.max_by(F.struct(*records.columns), F.struct(*others)).alias("record"))
    _write(one.select(_bucket(key).alias("bucket"), F.lit(sequence).cast("long").alias("sequence"), F.col(key).alias("key"), F.lit(False).alias("gone"), "record"), path)


def delete(ids: DataFrame, like: DataFrame, path: str, sequence: int, key: str = "id") -> None:
    """ids: key.  like: any records of the store, for their columns."""
    none = F.lit(None).cast(like.select(F.struct(*like.columns).alias("r")).schema["r"].dataType)
    _write(ids.select(key).distinct().select(_bucket(key).alias("bucket"), F.lit(sequence).cast("long").alias("sequence"), F.col(key).alias("key"), F.lit(True).alias("gone"), none.alias("record")), path)


def _latest(spark: SparkSession, path: str, upto: int | None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows if upto is None else rows.where(F.col("sequence") <= upto)
    return rows.groupBy("bucket", "key").agg(F.max_by(F.struct("sequence", "gone", "record"), "sequence").alias("x"), F.count("*").alias("n")).select("bucket", "key", "x.*", "n")


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The records as they are now, or were after the sequence `upto` (as far back as the last compaction)."""
    return _latest(spark, path, upto).where("not gone").select("record.*")


def sequences(path: str) -> list[tuple[int, str]]:
    """(sequence, folder) of every folder of the store."""
    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((int(f.base_name.split("=")[1]), f.path) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("sequence="))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """The state after `upto` as one file a bucket; a deletion goes once nothing older than it is there."""
    rows = _latest(spark, path, upto).where("not gone or n > 1").select("bucket", F.lit(upto).cast("long").alias("sequence"), "key", "gone", "record")
    rows = stored(rows, "store-compact")  # what is read may not be overwritten meanwhile
    old = [folder for n, folder in sequences(path) if n <= upto]
    _write(rows, path)
    kept = {f"bucket={r['bucket']}/sequence={upto}" for r in rows.select("bucket").distinct().collect()}
    system, _ = opened(path)
    for folder in old:
        if "/".join(folder.split("/")[-2:]) not in kept:
            system.delete_dir(folder)


def stream_into(stream: DataFrame, path: str, checkpoint: str, key: str = "id", first: int = 0) -> None:
    """Puts what is there of a stream, a batch a sequence (from `first` on), and returns.  Run again with the same
    checkpoint it goes on; a batch that was written but not committed is written over."""
    def batch(rows: DataFrame, number: int) -> None:
        put(rows, path, first + number, key)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

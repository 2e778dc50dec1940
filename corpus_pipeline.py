"""The corpus pipeline: quality filter, line and passage de-duplication, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return
the columns of documents, with n_chars of the text as it then is.  Documents that a stage empties by removing
repeats go; documents that were empty before are left to the quality stage.  Rows with a null doc_id can't be
told apart, so the stages that drop documents keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import jaccard_join, line_dedup, packing, quality, suffix_dedup
from talkloom.llm.common import small_batches, table, written

#: Lists of ids up to this length are broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those with an id in ids (doc_id)."""
    ids = written(ids.select("doc_id").distinct(), "pipeline-ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*docs.columns)


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judged(docs, table(spark, sf_dir, "labels"))
    return without(docs, judged.where("predicted = 0"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & (F.trim("text") == "")
    return measured(clean.where(~F.coalesce(emptied, F.lit(False))), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    return without(docs, groups.where("component_id <> doc_id"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    left = suffix_dedup.as_text(suffix_dedup.remove_repeats(docs))
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return measured(left.where(~emptied), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack_documents(docs, forget=True)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("passage_dedup", drop_repeated_passages),
    ("packing", pack),
]
#: The stages use a trained model, rolling hashes and token ids, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""Queries over files that Spark writes from the given tables and reads back: recordings, digests, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import files
from ..sources import sessions as src
from ..sources.shared import shared_dir
from .tables import read

#: Documents of one file, samples of one recording, bytes of one range.
DOCS, SAMPLES, RANGE = 20, 200, 16_384


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def recordings(spark, sf_dir):
    """Events in stretches as sound files, of which only the headers are read back."""
    e = read(spark, sf_dir, "events").select(F.expr(f"event_id div {SAMPLES}").alias("g"), "event_id", F.expr("cast(value as int)").alias("v"))
    each = e.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("event_id", "v"))).alias("p"))
    each = each.select("g", F.transform("p", lambda x: x["v"]).alias("samples"), F.expr("cast(7 + g % 5 as int)").alias("rate"), F.expr("cast(1 + g % 2 as int)").alias("channels"))
    path = _folder(spark, "recordings")
    files.write_files(each.select(F.concat(F.lit("r"), F.col("g").cast("string"), F.lit(".wav")).alias("name"), files.wave("samples", "rate", "channels").alias("content")), path)
    return files.read_recordings(spark, path)


def file_manifest(spark, sf_dir):
    """Documents in files of DOCS each, with the digests of the whole and of its ranges."""
    d = read(spark, sf_dir, "documents").select(F.expr(f"doc_id div {DOCS}").alias("g"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    each = d.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "").cast("binary")
    path = _folder(spark, "manifest")
    files.write_files(each.select(F.concat(F.lit("d"), F.col("g").cast("string"), F.lit(".txt")).alias("name"), body.alias("content")), path)
    return files.manifest(spark, path, "*.txt", RANGE)


def report_files(spark, sf_dir):
    """Each conversation's turns as a report in a folder of its own, read back as whole texts."""
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    path = _folder(spark, "reports")
    src.write_reports(c.select(F.concat(F.lit("report-"), F.col("conv_id").cast("string")).alias("name"), body.alias("body")), path)
    back = src.read_reports(spark, path)
    return back.select("name", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (recordings, file_manifest, report_files)}

ORACLES = {
    "recordings": f"""WITH g AS (SELECT event_id // {SAMPLES} AS g, count(*) AS n FROM events GROUP BY ALL)
SELECT 'r' || g || '.wav' AS filename, 44 + 2 * n AS length, 7 + g % 5 AS sample_rate, 1 + g % 2 AS channels, (2 * n * 1000) // ((7 + g % 5) * (1 + g % 2) * 2) AS duration_ms FROM g""",
    "file_manifest": f"""WITH f AS (SELECT doc_id // {DOCS} AS g, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS t FROM documents GROUP BY ALL),
h AS (SELECT g, sha256(t) AS sha256, hex(encode(t)) AS x, octet_length(encode(t)) AS length FROM f),
p AS (SELECT g, unnest(range(0, greatest(length, 1), {RANGE})) AS pos FROM h),
d AS (SELECT g, pos, sha256(unhex(substr(x, 2 * pos + 1, {2 * RANGE}))) AS s FROM p JOIN h USING (g)),
t AS (SELECT g, count(*)::INT AS n_parts, sha256(unhex(string_agg(s, '' ORDER BY pos))) AS tree_sha256 FROM d GROUP BY ALL)
SELECT 'd' || g || '.txt' AS filename, length, sha256, n_parts, tree_sha256 FROM h JOIN t USING (g)""",
    "report_files": """WITH r AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) || chr(10) AS body FROM conversations GROUP BY ALL)
SELECT 'report-' || conv_id AS name, octet_length(encode(body)) AS bytes, sha256(body) AS sha256 FROM r""",
}

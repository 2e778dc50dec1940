"""URL verdicts by host rules and, where no rule fits, by a path-template tree with labelled purity.

Per host, paths form a tree of segments.  Digits and long hexadecimal names in a segment are generalised at once
({n}, {h}).  Then, level by level: where a node has MANY children or more, those with under 1 / MANY of its urls are a
variable segment and become one wildcard (*); children whose labelled urls don't differ from the node as a whole (a
test of proportions at Z deviations, or no label) are merged into one branch (~).  So a node keeps MANY + 2 branches
at most, however many urls it has.  The purity of a template is the share of bad urls among its labelled ones,
smoothed by PRIOR urls of its parent's purity, up to the host and the whole table; templates above CUT are rejected.

Levels are grouped sums over distinct (host, segments), joined back by the child; they are stored level by level.
No host or node meets in one task: sums are combined before the shuffle and large joins can be split.

Edge cases: a null url, or one without "://", has an empty host and path; an empty path has no segment, and its template is the
host; segments beyond DEPTH count as one (**); rows with a null label count as urls only; without any label the purity
is one half everywhere, which rejects nothing; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

MANY, DEPTH, Z, PRIOR, CUT = 20, 6, 2.0, 8.0, 0.5
#: Templates up to this number are broadcast to the urls; more are shuffled.
BROADCAST_TEMPLATES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of the url column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule (verdict, host, start of the path) that fits host or a subdomain of it, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def segments(path: str) -> Column:
    """Segments of the path, digits and hexadecimal names generalised."""
    shape = lambda s: F.regexp_replace(F.regexp_replace(s, "^[0-9a-fA-F-]{16,}$", "{h}"), "[0-9]+", "{n}")
    all_ = F.transform(F.split(F.substring(F.col(path), 2, F.length(path)), "/"), shape)
    cut = F.when(F.size(all_) > DEPTH, F.concat(F.slice(all_, 1, DEPTH - 1), F.array(F.lit("**")))).otherwise(all_)
    return F.when(F.col(path) == "", F.array().cast("array<string>")).otherwise(cut)


def templates(urls: DataFrame) -> DataFrame:
    """host, segs, template, purity of each distinct (host, segs).  urls: host, segs, bad (1, 0 or null)."""
    paths = written(urls.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")), "url-paths")
    whole = paths.agg(F.coalesce(F.sum("lab"), F.lit(0)).alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.max(F.size("segs")).alias("deep")).first()
    start = F.lit((whole["bad"] + 1.0) / (whole["lab"] + 2.0))
    hosts = paths.groupBy("host").agg(F.sum("lab").alias("lab_h"), F.sum("bad").alias("bad_h"))
    hosts = hosts.select("host", ((F.col("bad_h") + PRIOR * start) / (F.col("lab_h") + PRIOR)).alias("purity"))
    tree = written(paths.join(hosts, "host").select("host", "segs", "n", "lab", "bad", F.lit("").alias("template"), "purity"), "url-tree")
    for d in range(1, min(DEPTH, whole["deep"] or 0) + 1):
        here = tree.where(F.size("segs") >= d).withColumn("seg", F.element_at("segs", d))
        child = written(here.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.max("purity").alias("purity")), "url-children")
        node = child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("n_"), F.sum("lab").alias("lab_"), F.sum("bad").alias("bad_"))
        both = child.join(node, ["host", "template"])
        rate = (F.col("bad_") + 1.0) / (F.col("lab_") + 2.0)
        off = F.col("bad") - F.col("lab") * rate
        branch = (F.when((F.col("kids") >= MANY) & (F.col("n") * MANY < F.col("n_")), F.lit("*"))
                  .when(off * off <= Z * Z * F.col("lab") * rate * (1.0 - rate), F.lit("~")).otherwise(F.col("seg")))
        child = both.select("host", "template", "seg", F.concat("template", F.lit("/"), branch).alias("next"), "lab", "bad", "purity")
        grown = child.groupBy("host", "template", "next").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"), F.max("purity").alias("purity"))
        grown = grown.select("host", "template", "next", ((F.col("bad") + PRIOR * F.col("purity")) / (F.col("lab") + PRIOR)).alias("pure"))
        step = child.select("host", "template", "seg", "next").join(grown, ["host", "template", "next"])
        grew = here.join(step, ["host", "template", "seg"]).select("host", "segs", "n", "lab", "bad", F.col("next").alias("template"), F.col("pure").alias("purity"))
        tree = written(tree.where(F.size("segs") < d).unionByName(grew), "url-tree")
    return tree.select("host", "segs", "template", "purity")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, template, purity of every row.  labels: key, bad (1, 0 or null), one row a key."""
    host, path = host_and_path("_url")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select("_key", host.alias("host"), path.alias("path")).withColumn("segs", segments("path"))
    labels = labels.select(F.col(key).alias("_key"), F.col("bad").alias("bad"))
    known = written(templates(rows.join(labels, "_key", "left").select("host", "segs", "bad")), "url-templates")
    judged = rows.join(F.broadcast(known) if known.count() <= BROADCAST_TEMPLATES else known, ["host", "segs"])
    rule, verdict = ruled(rules)
    own = F.when(F.col("purity") > CUT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.concat("host", "template").alias("template"), F.round("purity", 6).alias("purity"))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: pages show the document whose id ends their path, and are bad as it is of low quality or toxic."""
    _, path = host_and_path("url")
    number = pages.select("page_id", F.regexp_extract(path, "([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("long").alias("doc_id")).where("page_id is not null").distinct()
    bad = labels.groupBy("doc_id").agg(F.max(F.expr("cast(quality = 0 or toxic = 1 as int)")).alias("bad"))
    return number.join(bad, "doc_id").groupBy("page_id").agg(F.max("bad").alias("bad"))


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")))


def _levels() -> str:
    out = []
    for d in range(1, DEPTH + 1):
        out.append(f"""
h{d} AS (SELECT *, segs[{d}] AS seg FROM t{d - 1} WHERE len(segs) >= {d}),
c{d} AS (SELECT host, template, seg, sum(n)::BIGINT AS n, sum(lab)::BIGINT AS lab, sum(bad)::BIGINT AS bad, max(purity) AS purity FROM h{d} GROUP BY ALL),
n{d} AS (SELECT host, template, count(*) AS kids, sum(n)::BIGINT AS n_, (sum(bad)::BIGINT + 1.0::DOUBLE) / (sum(lab)::BIGINT + 2.0::DOUBLE) AS rate FROM c{d} GROUP BY ALL),
b{d} AS (SELECT c.host, c.template, seg, lab, bad, purity, c.template || '/' || CASE WHEN kids >= {MANY} AND n * {MANY} < n_ THEN '*'
  WHEN (bad - lab * rate) * (bad - lab * rate) <= {Z * Z}::DOUBLE * lab * rate * (1.0::DOUBLE - rate) THEN '~' ELSE seg END AS next FROM c{d} c JOIN n{d} n ON c.host = n.host AND c.template = n.template),
g{d} AS (SELECT host, template, next, (sum(bad)::BIGINT + {PRIOR}::DOUBLE * max(purity)) / (sum(lab)::BIGINT + {PRIOR}::DOUBLE) AS pure FROM b{d} GROUP BY ALL),
t{d} AS (SELECT * FROM t{d - 1} WHERE len(segs) < {d} UNION ALL
  SELECT h.host, h.segs, h.n, h.lab, h.bad, b.next, g.pure FROM h{d} h JOIN b{d} b ON h.host = b.host AND h.template = b.template AND h.seg = b.seg JOIN g{d} g ON b.host = g.host AND b.template = g.template AND b.next = g.next)""")
    return ",".join(out)


def _cases(pick) -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in ordered) + " END"


OP12_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), split_ AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest
), parts AS (
  SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM split_
), shaped AS (
  SELECT page_id, host, path, CASE WHEN path = '' THEN []::VARCHAR[] ELSE list_transform(string_split(substr(path, 2), '/'), lambda s: regexp_replace(regexp_replace(s, '^[0-9a-fA-F-]{{16,}}$', '{{h}}'), '[0-9]+', '{{n}}', 'g')) END AS all_ FROM parts
), rows_ AS (
  SELECT page_id, host, path, CASE WHEN len(all_) > {DEPTH} THEN list_append(all_[1:{DEPTH - 1}], '**') ELSE all_ END AS segs FROM shaped
), bads AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), labelled AS (
  SELECT page_id, max(bad) AS bad FROM (SELECT page_id, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9/]*/?$', 1) AS BIGINT) AS doc_id FROM parts) JOIN bads USING (doc_id) GROUP BY page_id
), paths AS (
  SELECT host, segs, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0)::BIGINT AS bad FROM rows_ LEFT JOIN labelled USING (page_id) GROUP BY host, segs
), whole AS (SELECT (sum(bad)::BIGINT + 1.0::DOUBLE) / (sum(lab)::BIGINT + 2.0::DOUBLE) AS start FROM paths
), hosts AS (SELECT host, (sum(bad)::BIGINT + {PRIOR}::DOUBLE * any_value(start)) / (sum(lab)::BIGINT + {PRIOR}::DOUBLE) AS purity FROM paths, whole GROUP BY host
), t0 AS (SELECT p.host, segs, n, lab, bad, '' AS template, purity FROM paths p JOIN hosts h ON p.host = h.host
),{_levels()}
SELECT page_id, r.host, path, {_cases(lambda v, h, p: h + p)} AS rule, coalesce({_cases(lambda v, h, p: v)}, CASE WHEN purity > {CUT} THEN 'block' ELSE 'allow' END) AS verdict,
       r.host || template AS template, round(purity, 6) AS purity
FROM (SELECT page_id, host, path, segs FROM rows_) r JOIN (SELECT host AS th, segs AS ts, template, purity FROM t{DEPTH}) t ON r.host = th AND r.segs = ts
"""

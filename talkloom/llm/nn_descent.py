"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy graph search.

Building.  Equal vectors are one node.  Random hyperplanes deal the nodes into small blocks (BLOCK at most, in
each of TREES trees); neighbours within blocks start the graph.  Blocks that come out too large, as in dense
regions, are split by further hyperplanes at their own medians.  Then, round by round and at every size, each
node meets its neighbours and a share of those that name it, in one join; all pairs among them of which one
came in the round before are tried, and the EACH best for either side that beat its worst neighbour go into
the next graph.  Nodes that nothing new has reached meet nobody, so rounds get smaller.  They end when less
than CHANGED of the edges are new; ROUNDS is only a bound against running on for ever.
Nearness is the inner product: vectors are scaled by the norm of the longest but LONGEST, and get one more
component that makes all norms equal (less 1, so that it keeps its digits), so that the graph stands on
distance and the order by inner product is kept.  The LONGEST are entries of every query, so that a few very
long ones neither blur the others nor are missed.  Vectors are shuffled as float32.

Searching.  Queries with equal vectors are one.  They are dealt by hyperplanes into blocks of QUERIES at most;
a block shares what it meets, so a node's vector is sent to it once.  A query starts at its own node, at
ENTRIES fixed nodes and the longest; each round it opens the OPEN best nodes of its pool, and the block meets
their neighbours and scores them for all its queries; rounds end when the best POOL of each query are open.
Pools are a table between rounds; nothing of queries or vectors goes through the driver.
The index covers every row; nothing is fitted on a sample but the hyperplanes' offsets (SAMPLE rows).

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part; with fewer candidates than asked for, all come back; ties go to the smaller id;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, table, written

K, BLOCK, TREES, ROUNDS, CHANGED, REVERSE, EACH, SAMPLE, SEED = 32, 256, 4, 40, 0.01, 20, 12, 4000, 5
POOL, OPEN, ENTRIES, LONGEST, SEARCH_ROUNDS, QUERIES = 64, 16, 32, 32, 60, 256


def matrix(column, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(-1, width)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    df = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    df = df.where(fine & F.exists("v", lambda x: x != 0))
    size = df.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return df.where(F.size("v") == (size["n"] if size else 0))


def norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def closeness(x: np.ndarray) -> np.ndarray:
    """Minus half the squared distance of each pair of rows; from the shortest row on, to keep digits."""
    x = x - x[np.argmin(np.einsum("nd,nd->n", x, x))]
    square = np.einsum("nd,nd->n", x, x) / 2
    return x @ x.T - square[:, None] - square[None, :]


def nodes(df: DataFrame) -> tuple[DataFrame, DataFrame, int, list[int]]:
    """(node, vec: float32 bytes with the extra component), (node, id), the width of vec and the longest nodes."""
    classes = df.groupBy("v").agg(F.min("id").alias("node"))
    most = F.array_max(F.transform("v", F.abs))
    norm = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    long = classes.select("node", norm.alias("norm")).orderBy(F.desc("norm"), "node").limit(LONGEST + 1).collect()
    unit = long[-1]["norm"] if long else 1.0
    width = (classes.select(F.size("v")).first() or [0])[0] + 1

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
            size = norms(x) / unit
            square = np.minimum(size, 1) ** 2
            extra = -square / (1 + np.sqrt(1 - square))
            x = x / unit * np.minimum(1, 1e15 / size)[:, None]  # squares must fit in float32
            full = np.column_stack([x, extra]).astype(np.float32)
            yield pd.DataFrame({"node": pdf["node"], "vec": [r.tobytes() for r in full]})

    out = written(classes.mapInPandas(run, "node long, vec binary"), "ann-nodes")
    return out, df.join(classes, "v").select("node", "id"), width, [r["node"] for r in long[:LONGEST]]


def best(found: DataFrame, k: int) -> DataFrame:
    """node, nbrs and sims: the k best distinct of found (node, nbr, sim) for each node."""
    found = found.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    ranked = found.groupBy("node").agg(F.collect_list(F.struct((-F.col("sim")).alias("d"), "nbr")).alias("l"))
    top = F.slice(F.sort_array("l"), 1, k)
    return ranked.select("node", F.transform(top, lambda x: x["nbr"]).alias("nbrs"), F.transform(top, lambda x: -x["d"]).alias("sims"))


def cells(vecs: DataFrame, width: int, n: int, trees: int, size: int) -> DataFrame:
    """tree, code, node, vec: vecs (node, vec) dealt by hyperplanes into cells of some `size` nodes for each tree."""
    rng = np.random.default_rng(SEED)
    levels = max(0, int(np.ceil(np.log2(max(n, 1) / size))))
    some = vecs.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))).limit(2 * SAMPLE)
    data = matrix([r["vec"] for r in some.collect()] or [bytes(4 * width)], np.float32, width)
    planes = rng.normal(size=(trees, max(levels, 1), width)).astype(np.float32)
    offsets = np.median(np.einsum("nd,tld->tln", data, planes), axis=2)

    def deal(batches):
        for pdf in batches:
            x = matrix(pdf["vec"], np.float32, width)
            for t in range(trees if levels else 1):
                bits = (x @ planes[t, :levels].T > offsets[t, :levels]) if levels else np.zeros((len(x), 0), bool)
                # a leading 1, so that codes of all depths differ
                yield pd.DataFrame({"tree": t, "code": (1 << levels) + bits @ (1 << np.arange(levels)), "node": pdf["node"], "vec": pdf["vec"]})

    dealt = written(vecs.mapInPandas(deal, "tree int, code long, node long, vec binary"), "ann-blocks")
    return split(dealt, width, size)


def blocks(vecs: DataFrame, width: int, n: int) -> DataFrame:
    """node, nbr, sim within the blocks of each tree."""
    dealt = cells(vecs, width, n, TREES, min(BLOCK, max(4 * K, n // 8)))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = matrix(pdf["vec"], np.float32, width), pdf["node"].to_numpy()
        sim = closeness(x)
        np.fill_diagonal(sim, -np.inf)
        k = min(K, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"node": [], "nbr": [], "sim": []})
        at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"node": np.repeat(ids, k), "nbr": ids[at].ravel(), "sim": np.take_along_axis(sim, at, axis=1).ravel()})

    return dealt.groupBy("tree", "code").applyInPandas(near, "node long, nbr long, sim float")


def split(dealt: DataFrame, width: int, size: int) -> DataFrame:
    """dealt with each block of over twice size halved at the median of a new hyperplane until none is left.
    What stands on the median is dealt by a hash, so that vectors no hyperplane tells apart are split too."""
    done, depth = None, 0
    while True:
        sizes = dealt.groupBy("tree", "code").agg(F.count("*").alias("rows"))
        large = written(sizes.where(F.col("rows") > 2 * size).select("tree", "code"), "ann-large")
        if large.isEmpty():
            return dealt if done is None else done.union(dealt)
        fine = dealt.join(large, ["tree", "code"], "left_anti")
        done = fine if done is None else done.union(fine)
        planes = np.random.default_rng([SEED, depth]).normal(size=(TREES, width)).astype(np.float32)

        def project(batches, planes=planes):
            for pdf in batches:
                x = matrix(pdf["vec"], np.float32, width)
                yield pdf.assign(p=np.einsum("nd,nd->n", x, planes[pdf["tree"].to_numpy()]))

        rows = dealt.join(large, ["tree", "code"], "left_semi").select("tree", "code", "node", "vec")
        rows = written(rows.mapInPandas(project, "tree int, code long, node long, vec binary, p float"), "ann-split")
        middle = rows.groupBy("tree", "code").agg(F.percentile_approx("p", 0.5).alias("m"))
        coin = F.pmod(F.xxhash64("node", "tree", F.lit(depth)), F.lit(2)) == 0
        upper = (F.col("p") > F.col("m")) | ((F.col("p") == F.col("m")) & coin)
        dealt = written(rows.join(middle, ["tree", "code"]).select("tree", (F.col("code") * 2 + upper.cast("long")).alias("code"), "node", "vec"), "ann-blocks")
        depth += 1


def local_join(graph: DataFrame, vecs: DataFrame, width: int, turn: int) -> DataFrame:
    """node, nbr, sim: new pairs among the neighbours of a common node that beat one side's worst, the EACH best
    of a side.  graph: node, nbrs, sims, fresh.  Which of those that name a node it meets depends on turn; those
    that came last go first."""
    worst = F.when(F.size("nbrs") < K, F.lit(float("-inf"))).otherwise(F.element_at("sims", -1))
    ahead = graph.select(F.col("node").alias("hub"), F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select("hub", F.col("e.nbrs").alias("node"), F.col("e.fresh").alias("fresh"))
    order = Window.partitionBy("hub").orderBy(F.desc("fresh"), F.xxhash64("node", "hub", F.lit(turn)))
    back = ahead.select(F.col("node").alias("hub"), F.col("hub").alias("node"), "fresh")
    back = back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE).drop("r")
    meet = ahead.union(back).groupBy("hub", "node").agg(F.max("fresh").alias("fresh"))
    meet = meet.withColumn("any", F.max("fresh").over(Window.partitionBy("hub"))).where("any").drop("any")
    full = vecs.join(graph, "node", "left").select("node", "vec", F.coalesce(worst, F.lit(float("-inf"))).cast("float").alias("worst"))
    rows = meet.join(full, "node").repartition("hub").sortWithinPartitions("hub")

    def pairs(hub_rows):
        ids = hub_rows["node"].to_numpy()
        x = matrix(hub_rows["vec"], np.float32, width)
        floor, fresh = hub_rows["worst"].to_numpy(), hub_rows["fresh"].to_numpy(bool)
        sim = closeness(x)
        sim[~((sim > floor[:, None]) & (fresh[:, None] | fresh[None, :]))] = -np.inf
        np.fill_diagonal(sim, -np.inf)
        if len(ids) > EACH:
            sim[sim < -np.partition(-sim, EACH - 1, axis=1)[:, EACH - 1 : EACH]] = -np.inf
        i, j = np.nonzero(sim > -np.inf)
        return ids[i], ids[j], sim[i, j]

    def run(batches):
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            hubs = pdf["hub"].to_numpy()
            starts = np.flatnonzero(np.append(True, hubs[1:] != hubs[:-1])) if len(hubs) else np.zeros(0, int)
            held = pdf.iloc[starts[-1] :] if len(starts) else None
            got = [pairs(pdf.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            if got:
                yield pd.DataFrame(dict(zip(("node", "nbr", "sim"), map(np.concatenate, zip(*got, strict=True)), strict=True)))
        if held is not None and len(held):
            yield pd.DataFrame(dict(zip(("node", "nbr", "sim"), pairs(held), strict=True)))

    return rows.mapInPandas(run, "node long, nbr long, sim float")


def edges(graph: DataFrame) -> DataFrame:
    return graph.select("node", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).select("node", F.col("e.nbrs").alias("nbr"), F.col("e.sims").cast("float").alias("sim"))


def build(vecs: DataFrame, width: int) -> DataFrame:
    """node, nbrs, sims of the neighbour graph."""
    n = vecs.count()
    every = F.transform("nbrs", lambda x: F.lit(True)).alias("fresh")
    graph = written(best(blocks(vecs, width, n), K).select("node", "nbrs", "sims", every), "ann-graph")
    for turn in range(ROUNDS):
        new = best(edges(graph).union(local_join(graph, vecs, width, turn)), K)
        was = graph.select("node", F.col("nbrs").alias("was"))
        fresh = F.transform("nbrs", lambda x: ~F.coalesce(F.array_contains("was", x), F.lit(False))).alias("fresh")
        graph = written(new.join(was, "node", "left").select("node", "nbrs", "sims", fresh), "ann-graph")
        free(vecs.sparkSession)
        total, changed = graph.agg(F.sum(F.size("nbrs")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if (changed or 0) <= CHANGED * (total or 0):
            break
    return graph.select("node", "nbrs", "sims")


def search(graph: DataFrame, vecs: DataFrame, queries: DataFrame, width: int, k: int, longest: list[int]) -> DataFrame:
    """query, node, score of the POOL (or 2k) best nodes found.  queries: query (its own node), qvec."""
    pool_size = max(POOL, 2 * k)
    fixed = [r["node"] for r in vecs.orderBy(F.xxhash64("node")).limit(max(ENTRIES, k + 1)).select("node").collect()]
    fixed = F.array(*[F.lit(x).cast("long") for x in sorted({*fixed, *longest})]) if fixed else F.array().cast("array<long>")
    order = Window.partitionBy("node").orderBy(F.xxhash64("nbr", "node"))
    back = graph.select(F.explode("nbrs").alias("node"), F.col("node").alias("nbr"))
    back = back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE).groupBy("node").agg(F.collect_list("nbr").alias("backs"))
    none = F.array().cast("array<long>")
    links = written(graph.select("node", "nbrs").join(back, "node", "full").select("node", F.array_union(F.coalesce("nbrs", none), F.coalesce("backs", none)).alias("links")), "ann-links")

    placed = cells(queries.select(F.col("query").alias("node"), F.col("qvec").alias("vec")), width, queries.count(), 1, QUERIES // 2)
    pools = placed.select(F.col("code").alias("block"), F.col("node").alias("query"), F.col("vec").alias("qvec"), none.alias("nodes"),
                          F.array().cast("array<float>").alias("scores"), F.array().cast("array<boolean>").alias("opened"), none.alias("turn"))
    schema, pools = pools.schema, written(pools, "ann-pools")
    reached = pools.select("block", F.explode(F.array_union(F.array("query"), fixed)).alias("node")).distinct()
    seen = None
    for _ in range(SEARCH_ROUNDS):
        reached = written(reached, "ann-reached")
        if reached.isEmpty():
            break
        seen = reached if seen is None else seen.union(reached)
        rows = reached.join(vecs, "node").select("block", "node", "vec")
        pools = written(pools.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(scored(width, pool_size), schema), "ann-pools")
        turn = pools.select("block", F.explode("turn").alias("node")).distinct()
        reached = turn.join(links, "node").select("block", F.explode("links").alias("node")).distinct().join(seen, ["block", "node"], "left_anti")
    return pools.select("query", F.explode(F.arrays_zip("nodes", "scores")).alias("x")).select("query", F.col("x.nodes").alias("node"), F.col("x.scores").alias("score"))


def scored(width: int, pool_size: int):
    """The step of a search: a block's pools and the nodes it has reached give the next pools."""

    def run(pools: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        if not len(pools):
            return pools
        new = reached["node"].to_numpy(np.int64)
        s = matrix(pools["qvec"], np.float32, width) @ matrix(reached["vec"], np.float32, width).T if len(new) else np.zeros((len(pools), 0), np.float32)
        nodes, scores, opened, turn = [], [], [], []
        for i in range(len(pools)):
            old = np.asarray(pools["nodes"].iloc[i], np.int64)
            use = np.argpartition(-s[i], pool_size)[:pool_size] if len(new) > pool_size else np.arange(len(new))
            node = np.concatenate([old, new[use]])
            score = np.concatenate([np.asarray(pools["scores"].iloc[i], np.float32), s[i][use]])
            done = np.concatenate([np.asarray(pools["opened"].iloc[i], bool), np.zeros(len(use), bool)])
            best_ = np.lexsort([node, -score])[:pool_size]
            node, score, done = node[best_], score[best_], done[best_]
            now = np.flatnonzero(~done)[:OPEN]
            done[now] = True
            nodes.append(node)
            scores.append(score)
            opened.append(done)
            turn.append(node[now])
        return pools.assign(nodes=nodes, scores=scores, opened=opened, turn=turn)

    return run


def nearest(df: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets is_query, its k nearest other rows found."""
    rows = written(usable(df, key, vector).join(
        df.where(is_query).select(F.col(key).cast("long").alias("id")).distinct().withColumn("asks", F.lit(True)), "id", "left"), "ann-rows")
    vecs, members, width, longest = nodes(rows.select("id", "v"))
    members = written(members, "ann-members")
    graph = build(vecs, width)
    asking = rows.where("asks").select(F.col("id").alias("query"), "v")
    asking = written(asking.join(members.withColumnRenamed("id", "query").withColumnRenamed("node", "start"), "query").select("query", "start", "v"), "ann-queries")
    firsts = asking.groupBy("start").agg(F.min_by("v", "query").alias("v"))
    found = search(graph, vecs, firsts.mapInPandas(query_bytes, "query long, qvec binary"), width, k, longest)
    found = found.withColumnRenamed("query", "start").join(asking.select("query", "start"), "start").select("query", "node")
    order = Window.partitionBy("node").orderBy("id")
    few = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    pairs = found.join(few, "node").where("id <> query").select("query", "id")
    vectors = rows.select("id", "v")
    full = pairs.join(vectors, "id").join(asking.select("query", F.col("v").alias("qv")), "query")
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = full.select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), dot.alias("score"))
    return out.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_bytes(batches):
    """Query vectors scaled to norm 1, which keeps the order, as float32 bytes, with 0 as the extra component."""
    for pdf in batches:
        x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        x = x / norms(x)[:, None]
        full = np.column_stack([x, np.zeros(len(x))]).astype(np.float32)
        yield pd.DataFrame({"query": pdf["start"], "qvec": [r.tobytes() for r in full]})


def op10_nn_descent(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 20 == 0)

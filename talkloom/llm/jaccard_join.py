"""Similarity join of documents on word 5-gram sets (Jaccard of 0.75 or more), exact up to hash collisions.

Universe partition with pigeonhole.  Sets fall into size bands; a band's pairs differ in at most a third of
the smaller set, so if shingles are hashed into more segments than that, linked sets agree in some segment.
A set shows the subset in each non-empty segment as a signature (in its own band and, if a smaller partner
may stand there, in the band below).  Allocation by cost: a set needs floor(difference) + 1 segments, and it
probes with those whose signatures the fewest sets share; signatures of its own cost nothing, most sets
probe nothing, and signatures shared by more than CAP sets are left out where others suffice.

Sets with too few non-empty segments (`lacking`) agree with others in empty ones only where both show them,
so their own probes prove nothing and they go on as sets that need more.

Sets that need more (`hard`) are counted again among themselves, where common passages are rare.  Of those
still hard, sets that too few cheap segments keep from a common one even if each covered two differences are
members of large families (`direct`): what they need over CAP makes blocks (components over common
signatures).  The others show empty segments too and one-deletion neighbourhoods (a segment less one
shingle): a segment shown so covers two differences, and each set buys the cheapest units.  What still needs
signatures over CAP makes blocks too.  A pair of a direct set and any other hard one is thus found by the
direct set's own signatures, a pair of others by units.

Each set is first paired with the smallest one of each signature that it probes, and what these links join
needs no pairs of its own: the pairs of a family of linked texts grow with its members.  Then come pairs of different
components.  A linked pair differs in a seventh of both sets at most, so it agrees in all but as many of the
signatures that a set needs; pairs that meet in fewer are no candidates.  Candidate pairs, each once, lose those whose
parity sketches differ in more bits than a linked pair's sets may differ in shingles (a bound that holds for every
pair), before they are kept.  The rest are verified on the whole sets; first
those with a set's smallest partner, then those between components that are still apart.  In a block, the
members of the largest component need no test among themselves: only the others (`minor`) are tested against
all members, by an inverted index, in tasks of SHINGLES shingles of either side; only a spanning forest of
the links leaves a task.

Copies of whole texts (equal SHA-256) are set aside first.  Sets are compared by 64-bit hashes of shingles;
words of over LONG bytes are hashed by BLAKE2b, so that no family of long words collides by its structure.
Results are thus exact up to collisions of 64-bit hashes.

Edge cases: null, empty and wordless texts have no shingles and link with nothing; texts of one to four
words are one shingle; a null key gets a null component; rows with equal keys stand for one document by
their union of links, each row with the set size of its own text; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, free, in_runs, mix, span_hashes, table, written

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
CAP, SLACK, SHINGLES, LONG = 48, 1.25, 1 << 20, 64
#: Lists of keys up to this length are broadcast; longer ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
OWN, BELOW, SIZE = 0, 1, 2
N_AT = 36  #: info holds the set size from this bit on
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MAX = [1]  #: largest set size of each band; neighbours are a factor of 1.5 apart
while _MAX[-1] < 1 << 40:
    _MAX.append(max(_MAX[-1] + 1, _MAX[-1] * 3 // 2))
MAX = np.array(_MAX)


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the word 5-grams, ascending."""
    a = np.frombuffer((text or "").encode(), np.uint8)
    a = np.where((a >= 65) & (a <= 90), a + np.uint8(32), a)
    edge = np.diff(np.concatenate([[0], ~_SPACE[a], [0]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, _U)
    h = span_hashes(a, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    n = len(h) - WORDS + 1
    if n < 1:
        return mix(np.array([np.bitwise_xor.reduce(mix(h + np.arange(1, len(h) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)))], _U) + _U(len(h)))
    out = np.zeros(n, _U)
    for k in range(WORDS):
        out = out * _U(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix(out))


def segments_of(band: int) -> int:
    h = int(MAX[band]) // 3
    return int(np.ceil(SLACK * (h + 1))) if h else 1


def shows(s: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, band, differences allowed) of each partition in which a set takes part."""
    n = len(s)
    band = int(np.searchsorted(MAX, n))
    out = [(OWN, band, n // 3)]
    if band and NUMERATOR * n <= DENOMINATOR * int(MAX[band - 1]):
        out.append((BELOW, band - 1, int(MAX[band - 1]) // 3))
    return out


def signatures(s: np.ndarray, band: int, allowed: int, deletions: bool = False):
    """Signatures of the segments shown, how many more there are than needed, and whether the set is lacking
    (1 or 0).  Empty segments are shown only by lacking sets.  With deletions: all segments, with their
    numbers, and those of each segment less one shingle."""
    m = segments_of(band)
    token = mix(s + _U(0xD6E8FEB86659FD93 * (band + 1) % 2**64))
    segment = ((token >> _U(20)) % _U(m)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    token, segment = token[order], segment[order]
    starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    ids, sums = segment[starts], np.add.reduceat(token, starts)
    lacking = len(ids) <= allowed
    if lacking or deletions:
        empty = np.setdiff1d(np.arange(m), ids)
        ids, sums = np.concatenate([ids, empty]), np.concatenate([sums, np.zeros(len(empty), _U)])
    place = _U(0xA0761D6478BD642F * (band + 1) % 2**64)
    plain = mix(mix(sums + place) + ids.astype(_U) * _U(0xE7037ED1A0B428DB))
    slack = len(ids) - (allowed + 1)
    if not deletions:
        return plain, slack, int(lacking)
    total = np.zeros(m, _U)
    total[ids] = sums
    less = mix(mix(total[segment] - token + place) + segment.astype(_U) * _U(0xE7037ED1A0B428DB))
    return ids, plain, segment, less


def signature_rows(docs: DataFrame) -> DataFrame:
    """sig, doc, info: (size << N_AT | slack << 3 | lacking << 2 | kind), and a row with the size of each set: (size << 2 | SIZE)."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), 200):
                sig, doc, info = [], [], []
                for key, text in zip(keys[lo : lo + 200], texts[lo : lo + 200], strict=True):
                    s = shingles(text)
                    parts = [(mix(np.array([key], np.int64).view(_U)), len(s) << 2 | SIZE)]
                    for kind, band, allowed in shows(s) if len(s) else ():
                        own, slack, lacking = signatures(s, band, allowed)
                        parts.append((own, len(s) << N_AT | slack << 3 | lacking << 2 | kind))
                    for own, i in parts:
                        sig.append(own)
                        doc.append(np.full(len(own), key, np.int64))
                        info.append(np.full(len(own), i, np.int64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(info))], ["sig", "doc", "info"])

    return docs.select("_node", "_text").mapInArrow(run, "sig long, doc long, info long")


def counted(rows: DataFrame, others: tuple[str, ...]) -> DataFrame:
    """rows (sig, ...) with freq, the number of rows with the same sig; rows alone are dropped, sizes kept.
    Sorted runs are counted as they stream by, so that common signatures need no join."""
    rows = rows.repartition("sig").sortWithinPartitions("sig")
    names = ["sig", *others]
    schema = rows.select(*names, F.lit(0).cast("long").alias("freq")).schema

    def run(batches):
        for columns, goes_on in in_runs(batches, names):
            sig = columns[0]
            starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            n = np.diff(np.append(starts, len(sig)))
            freq = np.repeat(n, n)
            if goes_on or len(sig) >= 1_000_000:  # a run that was cut is common in any case
                freq = np.where((sig == sig[0]) | (sig == sig[-1]), np.maximum(freq, CAP + 1), freq)
            use = freq > 1
            if "info" in others:
                use |= columns[names.index("info")] & 3 == SIZE
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (*columns, freq)], schema.names)

    return rows.mapInArrow(run, schema)


def allocate(rows: DataFrame) -> DataFrame:
    """rows: sig, doc, info, freq (over 1).  For each doc and info: probes, the cheapest signatures shared by
    CAP or fewer that a set needs besides its own, and, where it needs others or is lacking, all its rows."""
    each = rows.groupBy("doc", "info").agg(F.sort_array(F.collect_list(F.struct("freq", "sig"))).alias("l"))
    lacking = F.shiftright("info", 2).bitwiseAND(1) == 1
    slack = F.shiftright("info", 3).bitwiseAND((1 << N_AT - 3) - 1)
    need = F.greatest(F.size("l") - slack, F.lit(0)).cast("int")
    needed = F.slice("l", F.lit(1), need)
    probes = F.when(~lacking, F.filter(needed, lambda x: x["freq"] <= CAP))
    hot = F.filter(needed, lambda x: x["freq"] > CAP)
    hard = lacking | (F.size(hot) > 0)
    each = each.select("doc", "info", probes.alias("probes"), F.when(hard, F.col("l")).alias("hard"), hot.alias("hot"), need.alias("need"))
    return each.where((F.size("probes") > 0) | F.col("hard").isNotNull())


def size_of(info: str = "info") -> Column:
    return F.shiftright(info, N_AT)


def probes_of(plan: DataFrame, excused: Column | int = 0) -> DataFrame:
    """sig, doc, kind, n, least: of the signatures that a set needs (one more than the differences allowed), those
    that must be met by its probes if the partner does not differ at all; `excused` ones need not."""
    n, kind = size_of(), F.col("info").bitwiseAND(3)
    below = F.array_max(F.filter(F.array(*(F.lit(int(x)) for x in MAX[MAX < 1 << 31])).cast("array<long>"), lambda x: x < n))
    allowed = F.floor(F.when(kind == OWN, n).otherwise(below) / 3)
    return plan.select("doc", kind.alias("kind"), n.alias("n"), (allowed + 1 - excused).alias("least"), F.explode("probes").alias("x")).select("x.sig", "doc", "kind", "n", "least")


def united(stages: list[tuple[DataFrame, DataFrame, int]]) -> tuple[DataFrame, DataFrame]:
    """Each stage's probes (sig, doc, kind, n, least) and the sets (sig, doc, n) that show its signatures, as one table each; a
    signature that is met counts for as many units as the stage says."""
    probes, index = (None, None)
    for i, (p, s, unit) in enumerate(stages):
        p = p.select(F.lit(i).alias("stage"), "sig", F.col("doc").alias("x"), "kind", F.col("n").alias("m"), "least", F.lit(unit).alias("unit"))
        s = s.select(F.lit(i).alias("stage"), "sig", "doc", "n")
        probes, index = (p, s) if probes is None else (probes.union(p), index.union(s))
    return probes, index


def met(probes: DataFrame, index: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """Distinct (a, b), a < b, that may be linked.  Sets of n and m shingles that are linked differ in (n + m) / 7 at most, and
    each difference spoils one of the `least` signatures, so all others must be met.  Without part: only pairs of a set and
    the smallest one that shows a signature, no more than there are probes.  With part (node, component) of what is known
    to be linked: pairs of different components."""
    if part is None:
        index = index.groupBy("stage", "sig").agg(F.min(F.struct("doc", "n")).alias("first")).select("stage", "sig", "first.*")
        new = F.col("x") != F.col("doc")
    else:
        part = F.broadcast(part) if part.count() <= BROADCAST_KEYS else part
        named = lambda rows, doc, c: rows.join(part.select(F.col("node").alias(doc), F.col("component").alias(c)), doc, "left").withColumn(c, F.coalesce(c, doc))
        probes, index = named(probes, "x", "cx"), named(index, "doc", "cd")
        new = F.col("cx") != F.col("cd")
    both = probes.join(index, ["stage", "sig"]).where(new & (F.least("m", "n") * DENOMINATOR >= F.greatest("m", "n") * NUMERATOR))
    hits = both.groupBy("stage", "x", "kind", "doc").agg(F.sum("unit").alias("units"), F.max("m").alias("m"), F.max("n").alias("n"), F.max("least").alias("least"))
    differ = F.floor((F.col("m") + F.col("n")) * (DENOMINATOR - NUMERATOR) / (DENOMINATOR + NUMERATOR))
    hits = hits.where(F.col("units") >= F.col("least") - differ)
    return hits.select(F.least("x", "doc").alias("a"), F.greatest("x", "doc").alias("b")).distinct()


def parity(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of some 2n to 4n classes, as 64-bit words.  Sketches of two sets differ
    in no more bits than the sets in shingles."""
    words = 1 << max(2, (2 * len(s)).bit_length() - 6)
    bits = np.bincount((s >> _U(20) & _U(words * 64 - 1)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, its set (binary), n (set size) and sketch of the wanted docs."""
    n = wanted.count()
    wanted = F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], ["doc", "s", "n", "sketch"])

    return docs.join(wanted, docs["_node"] == wanted["doc"], "left_semi").select("_node", "_text").mapInArrow(run, "doc long, s binary, n long, sketch array<long>")


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave possible."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")), x)
    words = F.least(F.size("ka"), F.size("kb"))

    def folded(c: str):  # sizes are a factor of 4/3 apart at most, so sketches of 2 at most
        return F.when(F.size(c) > words, F.zip_with(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))

    pairs = pairs.where(F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR)
    bits = F.aggregate(F.zip_with(folded("ka"), folded("kb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return pairs.where(bits * (DENOMINATOR + NUMERATOR) <= (F.col("na") + F.col("nb")) * (DENOMINATOR - NUMERATOR)).select("a", "b")


def linked(common: int, n: int, m: int) -> bool:
    return DENOMINATOR * common >= NUMERATOR * (n + m - common)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")
    both = both.where(F.least(F.octet_length("sa"), F.octet_length("sb")) * DENOMINATOR >= F.greatest(F.octet_length("sa"), F.octet_length("sb")) * NUMERATOR)

    def run(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = []
            for p, q in zip(x, y, strict=True):
                both = np.sort(np.concatenate([np.frombuffer(p, _U), np.frombuffer(q, _U)]))
                ok.append(linked(int((both[1:] == both[:-1]).sum()), len(p) // 8, len(q) // 8))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def deletion_rows(hard: DataFrame, sets: DataFrame) -> DataFrame:
    """sig, doc, kind, size, need (units) of total (segments), segment and whether it lacks a shingle, of the hard
    sets (doc, info)."""
    both = sets.join(hard.groupBy("doc").agg(F.collect_set(F.col("info").bitwiseAND(3)).alias("kinds")), "doc").select("doc", "s", "kinds")

    def run(batches):
        for batch in batches:
            for doc, raw, kinds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = np.frombuffer(raw, _U)
                for kind, band, allowed in shows(s):
                    if kind in kinds:
                        ids, plain, segment, less = signatures(s, band, allowed, deletions=True)
                        n = len(plain) + len(less)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.concatenate([plain, less]).view(np.int64)), pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, kind, np.int64)),
                            pa.array(np.full(n, len(s), np.int64)), pa.array(np.full(n, allowed + 1, np.int64)), pa.array(np.full(n, len(ids), np.int64)), pa.array(np.concatenate([ids, segment])),
                            pa.array(np.repeat([0, 1], [len(plain), len(less)]))], ["sig", "doc", "kind", "n", "need", "total", "segment", "lacks"])

    return both.mapInArrow(run, "sig long, doc long, kind long, n long, need long, total long, segment long, lacks long")


def units(rows: DataFrame) -> DataFrame:
    """sig, doc, kind, n, least, freq, bought and hard.  rows: of deletion_rows, counted, without those alone, which cost
    nothing.  A segment's first unit is its plain signature, its second all those less one shingle; a set
    buys the units whose signatures are least shared, and is hard if it buys some shared by more than CAP.  `least` as
    in probes_of, in units; those of segments that it shows by a signature over CAP are excused."""
    each = rows.groupBy("doc", "kind", "n", "need", "total").agg(F.collect_list(F.struct("sig", "freq", "segment", "lacks")).alias("l"))

    def run(batches):
        for batch in batches:
            lists = batch.column(5)
            for i, (doc, kind, n, need, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                sig, freq, segment, lacks = (lists[i].values.field(c).to_numpy() for c in ("sig", "freq", "segment", "lacks"))
                plain = lacks == 0
                first, second = np.zeros(total, np.int64), np.zeros(total, np.int64)
                np.maximum.at(first, segment[plain], freq[plain] - 1)
                np.add.at(second, segment[~plain], freq[~plain] - 1)
                cost = np.stack([first, np.maximum(first, second)])
                unit, at = np.divmod(np.lexsort([np.repeat([0, 1], total), cost.ravel()])[:need], total)
                got = np.zeros((2, total), bool)
                got[unit, at] = True
                bought = np.where(plain, got[0][segment], got[1][segment])
                hot = np.unique(segment[bought & (freq > CAP)])
                hard = len(hot) > 0
                least = need - int(got[:, hot].sum())
                same = [pa.array(np.full(len(sig), x, np.int64)) for x in (doc, kind, n, least)]
                yield pa.RecordBatch.from_arrays([pa.array(sig), *same, pa.array(freq), pa.array(bought), pa.array(np.full(len(sig), hard))],
                                                 ["sig", "doc", "kind", "n", "least", "freq", "bought", "hard"])

    return each.mapInArrow(run, "sig long, doc long, kind long, n long, least long, freq long, bought boolean, hard boolean")


def stars(rows: DataFrame) -> DataFrame:
    """Distinct (a, b): each set b with the smallest set a that shows one of its common signatures, of those
    that some set has bought.  rows: sig, doc, bought."""
    of = Window.partitionBy("sig")
    first = rows.select(F.min("doc").over(of).alias("a"), F.col("doc").alias("b"), F.max("bought").over(of).alias("use"))
    return first.where("use AND a <> b").select("a", "b").distinct()


def block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) within each block that join its components to all they link with: minor members against
    all.  members: doc, block, component."""
    members = members.join(sets.select("doc", "n"), "doc")
    parts = members.groupBy("block", "component").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    most = parts.groupBy("block").agg(F.max(F.struct("k", "component"))["component"].alias("largest"), F.sum("n").alias("n"))
    most = most.join(parts.groupBy("block", "component").agg(F.sum("n").alias("own")).withColumnRenamed("component", "largest"), ["block", "largest"])
    pieces = lambda n: F.greatest(F.ceil(n / SHINGLES), F.lit(1)).cast("int")
    most = written(most.where("n > own").select("block", "largest", pieces(F.col("n") - F.col("own")).alias("chunks"), pieces(F.col("n")).alias("parts")), "join-large")
    at = members.join(most, "block").withColumn("h", F.abs(F.xxhash64("doc") % (1 << 40)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: (F.col("h") % F.col(n)).cast("int")
    minor = at.where("component <> largest").select("block", own("chunks").alias("chunk"), every("parts").alias("part"), "doc", "component", F.lit(True).alias("minor"))
    dealt = minor.union(at.select("block", every("chunks").alias("chunk"), own("parts").alias("part"), "doc", "component", F.lit(False)))
    dealt = dealt.join(sets.select("doc", "s"), "doc")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        few, all_ = pdf[pdf["minor"]], pdf[~pdf["minor"]]
        tokens = [np.frombuffer(x, _U) for x in few["s"]]
        size = np.array([len(x) for x in tokens], np.int64)
        docs, group = few["doc"].to_numpy(), few["component"].to_numpy()
        root: dict[int, int] = {}

        def find(i):
            while root.get(i, i) != i:
                root[i] = root.get(root[i], root[i])
                i = root[i]
            return i

        out = []
        if len(few):
            token, number = np.unique(np.concatenate(tokens), return_inverse=True)
            order = np.argsort(number, kind="stable")
            owner = np.repeat(np.arange(len(few)), size)[order]
            bounds = np.append(0, np.cumsum(np.bincount(number)))
            for doc, component, raw in zip(all_["doc"], all_["component"], all_["s"], strict=True):
                s = np.frombuffer(raw, _U)
                t = np.minimum(np.searchsorted(token, s), len(token) - 1)
                t = t[token[t] == s]
                n = bounds[t + 1] - bounds[t]
                spread = np.repeat(bounds[t] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                common = np.bincount(owner[spread], minlength=len(few))
                for j in np.flatnonzero((common > 0) & (DENOMINATOR * common >= NUMERATOR * (len(s) + size - common)) & (group != component)):
                    if (x := find(int(component))) != (y := find(int(group[j]))):
                        root[max(x, y)] = min(x, y)
                        out.append((doc, docs[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("block", "chunk", "part").applyInPandas(run, "a long, b long")


def sha() -> Column:
    return F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("sha")


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (_key, _text) with _node, a number of its own for each key and text: the key, but for keys with
    several texts; (_node, first) of each node whose text another node, first, stands for; and (_key, sha,
    _node) of the keys with several texts."""
    spark = docs.sparkSession
    texts = written(docs.select("_key", sha()).groupBy("_key", "sha").agg(F.count("*").alias("rows")), "join-texts")
    several = texts.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key")
    lowest = F.lit(min(0, texts.agg(F.min("_key")).first()[0] or 0))
    odd = written(texts.join(several, "_key", "left_semi").select("_key", "sha", (lowest - 1 - F.monotonically_increasing_id()).alias("_node")), "join-odd")
    if odd.isEmpty():
        docs, texts = docs.withColumn("_node", F.col("_key")), texts.withColumn("_node", F.col("_key"))
    else:
        docs = docs.withColumn("sha", sha()).join(odd, ["_key", "sha"], "left").select("_key", "_text", F.coalesce("_node", "_key").alias("_node"))
        texts = texts.join(odd, ["_key", "sha"], "left").select("_key", "sha", "rows", F.coalesce("_node", "_key").alias("_node"))
    firsts = texts.groupBy("sha").agg(F.min(F.struct("_key", "_node"))["_node"].alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    firsts = written(firsts, "join-firsts")
    few = firsts.count() <= BROADCAST_KEYS
    copies = written(texts.join(F.broadcast(firsts) if few else firsts, "sha").where("_node <> first").select("_node", "first"), "join-copies")
    again = texts.where("rows > 1").select("_node")
    if not again.isEmpty():  # one of each of the rows repeated whole
        again = written(again, "join-again")
        docs = docs.join(again, "_node", "left_anti").unionByName(docs.join(again, "_node", "left_semi").dropDuplicates(["_node"]))
    return docs, copies, odd


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key with n_shingles and component_id, the smallest key reachable by links."""
    spark = df.sparkSession
    rows_ = df.select(F.col(key).alias("_own"), F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs, copies, odd = told_apart(rows_.where("_key is not null").select("_key", "_text"))
    gone = copies.select("_node")
    unique = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "_node", "left_anti")

    rows = written(counted(signature_rows(unique), ("doc", "info")), "join-signatures")
    free(spark)
    sizes = rows.where(F.col("info").bitwiseAND(3) == SIZE).select(F.col("doc").alias("_node"), F.shiftright("info", 2).alias("n_shingles"))
    index = rows.where((F.col("info").bitwiseAND(3) != SIZE) & (F.col("freq") > 1))
    plan = written(allocate(index), "join-plan")
    again = plan.where("hard is not null").select("doc", "info", F.explode("hard").alias("x")).select("x.sig", "doc", "info")
    again = written(counted(again, ("doc", "info")), "join-again")
    plan2 = written(allocate(again), "join-plan")
    harder = plan2.where("hard is not null")
    free(spark)

    hard_sets = written(sets_of(unique, harder.select("doc").distinct()), "join-sets")
    # of the units needed (about a third of the set, and one) those not in `need` are free; a unit may count twice
    units_free = F.greatest(F.floor(F.col("n") / 3) + 1 - F.col("need"), F.lit(0))
    few = units_free + 2 * F.size(F.filter("hard", lambda x: x["freq"] <= CAP)) < F.col("need")
    lacking = F.shiftright("info", 2).bitwiseAND(1) == 1
    harder = written(harder.join(hard_sets.select("doc", "n"), "doc").select("doc", "info", "hot", "probes", (few & ~lacking).alias("direct")), "join-harder")
    apart = harder.where("not direct").select("doc", "info")
    dels = written(units(counted(deletion_rows(apart, hard_sets), ("doc", "kind", "n", "need", "total", "segment", "lacks"))), "join-deletions")
    wanted = harder.where("direct").select("doc", F.explode("hot").alias("x")).select("x.sig", "doc", F.lit(True).alias("bought"))
    family = wanted.union(again.where(F.col("freq") > CAP).select("sig", "doc", F.lit(False)))
    rest = dels.where(F.col("hard") & (F.col("freq") > CAP)).select("sig", "doc", "bought")
    star = written(stars(family).union(stars(rest)).distinct(), "join-stars")
    cheap = dels.where(F.col("bought") & (F.col("freq") <= CAP))
    # a set that is hard is met by the probes of those that are not, and by those of a later stage
    sized = lambda rows: rows.select("sig", "doc", size_of().alias("n"))
    direct = harder.where("direct")
    probes, index = united([(probes_of(plan.where("hard is null")), sized(index), 1),
                            (probes_of(plan2.where("hard is null")).union(probes_of(direct, F.size("hot"))), sized(again), 1),
                            (cheap, dels, 2)])  # a segment is two units at most
    # the smallest set of each signature first: families come together by few pairs, and their members need not all be paired
    first = written(met(probes, index).union(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")).distinct(), "join-first")
    free(spark)
    # members of blocks need their sets even where no pair names them
    sets = written(sets_of(unique, first.union(star).select(F.explode(F.array("a", "b")).alias("doc")).distinct()), "join-sets")
    links = written(verify(possible(first, sets), sets), "join-links")
    part = written(components(links, label="join-part"), "join-part")
    # whoever shows what another probes has its sketch at hand, so that pairs that it rules out are nowhere kept
    shown = index.join(probes.select("stage", "sig").distinct(), ["stage", "sig"], "left_semi").select("doc").distinct()
    more = written(shown.join(sets.select("doc"), "doc", "left_anti"), "join-shown")
    sets = sets.union(written(sets_of(unique, more), "join-sets"))
    pairs = written(possible(met(probes, index, part), sets), "join-pairs")  # blocks find the rest
    free(spark)

    # a set's smallest partner next; what it settles need not be verified pair by pair
    nearest = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = links.union(written(verify(nearest, sets), "join-links"))
    part = written(components(links, label="join-part"), "join-part")
    rest = pairs.join(nearest, ["a", "b"], "left_anti")
    rest = rest.join(part.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
    rest = rest.join(part.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    links = links.union(written(verify(rest, sets), "join-links"))
    blocks = components(star, label="join-blocks").select(F.col("node").alias("doc"), F.col("component").alias("block"))
    members = blocks.join(part.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "block", F.coalesce("component", "doc").alias("component"))
    links = links.union(written(block_links(written(members, "join-members"), sets), "join-forest"))

    renamed = not odd.isEmpty()
    if renamed:  # a key's texts are linked
        rep = odd.join(copies, "_node", "left").select("_key", F.coalesce("first", "_node").alias("_node"))
        rep = written(rep.join(sizes.where("n_shingles > 0").select("_node"), "_node", "left_semi"), "join-odd")
        links = links.union(rep.join(rep.groupBy("_key").agg(F.min("_node").alias("a")), "_key").where("a <> _node").select("a", F.col("_node").alias("b")))
    whole = written(components(links, label="join-whole"), "join-whole")
    if renamed:  # components are named by keys
        keys = odd.select(F.col("_node").alias("node"), F.col("_key").alias("k"))
        names = whole.join(keys, "node", "left").groupBy("component").agg(F.min(F.coalesce("k", "node")).alias("least"))
        alone = keys.join(whole, "node", "left_anti").select("node", F.col("k").alias("component"))
        whole = written(whole.join(names, "component").select("node", F.col("least").alias("component")).union(alone), "join-whole")
        at = rows_.select("_own", "_key", sha()).join(odd, ["_key", "sha"], "left").select("_own", "_key", F.coalesce("_node", "_key").alias("_node"))
    else:
        at = rows_.select("_own", "_key", F.col("_key").alias("_node"))

    at = at.join(copies, "_node", "left").select("_own", "_key", F.coalesce("first", "_node").alias("_node"))
    at = at.join(sizes, "_node", "left").join(whole.withColumnRenamed("node", "_node"), "_node", "left")
    own = F.when(F.coalesce("n_shingles", F.lit(0)) > 0, F.coalesce("component", "_node")).otherwise(F.col("_key"))
    return at.select(F.col("_own").alias(key), F.when(F.col("_key").isNotNull(), F.coalesce("n_shingles", F.lit(0))).alias("n_shingles"), own.alias("component_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))

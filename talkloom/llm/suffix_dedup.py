"""Removal of byte passages that an earlier document holds, by enhanced suffix arrays.

A byte is removed if a string of LEAST bytes that covers it also starts in a document with a smaller key.

1. Anchors.  In each window of LEAST bytes the GRAM-gram with the least hash is an anchor, so equal strings
   of LEAST bytes share one.  An anchor's context reaches LEAST - GRAM bytes to both sides and thus covers
   every string of LEAST bytes that holds it.  Only hashes are shuffled: gram, context, key.
2. Of the contexts of a gram that occurs in several documents, equal ones are pre-aggregated: all but the
   smallest document hold a copy of the whole context.  They are equal by two 64-bit hashes, of 20 and of 80
   bytes, which are too short to collide by their structure.  Where a gram has several contexts, one text
   each goes on.
3. Those texts meet by gram.  Their suffixes of LEAST bytes or more are sorted (the enhanced suffix array,
   cut at depth LEAST) with the lengths of common prefixes; a scan with a stack walks the tree of
   common-prefix intervals and gives, for each interval whose members differ in the byte to their left or
   begin their context, a maximal repeat with all its occurrences.  In each occurrence of a later document
   than the group's first, its bytes are covered.
4. Covered spans return to their documents and are united.

A gram with more than HOT contexts does not meet in one task: its strings of LEAST bytes are dealt and
aggregated one by one.  Copies of whole documents are set aside first, by SHA-256 of their text.

Edge cases: null texts count as empty; texts under LEAST bytes keep all; matches never cross documents; rows
with a null key are kept whole and match nothing; rows with equal keys, of one text or several, never remove
each other's bytes and are judged each by its own text; other columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, gram_hashes, in_runs, mix, slide, table, written

LEAST, GRAM, HOT = 50, 20, 20_000
#: Lists of copies up to this length are broadcast; longer ones are joined by a shuffle.
BROADCAST_COPIES = 1_000_000
SIDE = LEAST - GRAM
SPAN = LEAST + SIDE  #: bytes of a context
PAD = 256
_U = np.uint64


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, gram hash and context hash of each anchor."""
    if len(data) < LEAST:
        return (np.empty(0, np.int64), np.empty(0, _U), np.empty(0, _U))
    a = np.frombuffer(data, np.uint8)
    h = mix(gram_hashes(a, GRAM))
    w = SIDE + 1
    low = slide(h, w)
    edge = np.zeros(w - 1, _U)
    at = np.flatnonzero(slide(np.concatenate([edge, low, edge]), w, np.maximum) == h)
    side = np.full(SIDE, PAD, np.uint16)
    context = gram_hashes(np.concatenate([side, a, side]), SPAN)
    return at, h[at], mix(context[at])


def anchor_rows(docs: DataFrame) -> DataFrame:
    """gram, context, doc: distinct within a document."""

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), 100):
                out = []
                for key, text in zip(keys[lo : lo + 100], texts[lo : lo + 100], strict=True):
                    _, gram, context = anchors(text.encode())
                    if len(gram):
                        _, first = np.unique(gram ^ (context * _U(3)), return_index=True)
                        out.append((gram[first], context[first], np.full(len(first), key, np.int64)))
                if out:
                    gram, context, doc = map(np.concatenate, zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc)], ["gram", "context", "doc"])

    return docs.select("_key", "_text").mapInArrow(run, "gram long, context long, doc long")


def candidates(rows: DataFrame) -> DataFrame:
    """Of grams that occur in several documents: one row with `lead` for the smallest document of each
    context, if the gram has more contexts, and one without it for each other document of a context."""
    rows = rows.repartition("gram").sortWithinPartitions("gram", "context", "doc")

    def run(batches):
        before = None  # gram, context and smallest document at the end of a run that was cut
        for (gram, context, doc), goes_on in in_runs(batches, ["gram", "context", "doc"]):
            n = len(gram)
            new_gram = np.append(True, gram[1:] != gram[:-1])
            new_context = new_gram | np.append(True, context[1:] != context[:-1])
            starts = np.flatnonzero(new_gram)
            run_of = np.cumsum(new_gram) - 1
            several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
            contexts = np.add.reduceat(new_context, starts) > 1
            if goes_on or n >= 1_000_000:
                several[0] = contexts[0] = True
                if run_of[-1] != 0 and n >= 1_000_000:
                    several[-1] = contexts[-1] = True
            smallest = doc[np.flatnonzero(new_context)][np.cumsum(new_context) - 1]
            if goes_on and before is not None and before[0] == gram[0] and before[1] == context[0]:
                same = (gram == gram[0]) & (context == context[0])
                smallest = np.where(same, min(before[2], smallest[0]), smallest)
                new_context = new_context & ~same
            before = (gram[-1], context[-1], smallest[-1])
            lead = new_context & contexts[run_of]
            use = several[run_of] & (lead | (doc > smallest))
            yield pa.RecordBatch.from_arrays([pa.array(gram[use]), pa.array(context[use]), pa.array(doc[use]), pa.array(lead[use])], ["gram", "context", "doc", "lead"])

    return rows.mapInArrow(run, "gram long, context long, doc long, lead boolean")


def context_texts(docs: DataFrame, leads: DataFrame) -> DataFrame:
    """gram, context, doc, before (bytes left of the gram) and bytes, for each lead row."""
    asked = leads.groupBy("doc").agg(F.collect_list("context").alias("contexts"))
    both = docs.join(asked, docs["_key"] == asked["doc"]).select("doc", "_text", "contexts")

    def run(batches):
        for batch in batches:
            docs_, texts, wanted = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for doc, text, contexts in zip(docs_, texts, wanted, strict=True):
                data = text.encode()
                at, gram, context = anchors(data)
                signed = context.view(np.int64)
                _, first = np.unique(signed, return_index=True)
                for i in first[np.isin(signed[first], np.array(contexts, np.int64))].tolist():
                    p = int(at[i])
                    out.append((int(gram[i].view(np.int64)), int(signed[i]), doc, min(p, SIDE), data[max(0, p - SIDE) : p + LEAST]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SHIPPED, strict=True)], ["gram", "context", "doc", "before", "bytes"])

    return both.mapInArrow(run, "gram long, context long, doc long, before int, bytes binary")


SHIPPED = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def suffix_array(parts: list[bytes]):
    """Suffixes of LEAST bytes or more that share their first LEAST bytes with another, sorted so that equal
    beginnings stand together: part and offset of each, the common prefix with the one before (0 where not
    LEAST), and the byte to the left (-1 at the start of a part)."""
    n = len(parts)
    sizes = np.fromiter(map(len, parts), np.int64, n)
    text = np.full((n, SPAN + 1), PAD, np.int16)
    text[:, 0] = -1
    inside = np.arange(SPAN) < sizes[:, None]
    text[:, 1:][inside] = np.frombuffer(b"".join(parts), np.uint8)
    flat = text[:, 1:].ravel()
    grams = gram_hashes(flat, LEAST)
    grams = np.append(grams, np.zeros(len(flat) - len(grams), _U)).reshape(n, SPAN)
    part, offset = np.nonzero(np.arange(SPAN) <= (sizes - LEAST)[:, None])
    h = grams[part, offset]
    order = np.argsort(h, kind="stable")
    same = np.append(False, h[order][1:] == h[order][:-1])
    use = order[same | np.append(same[1:], False)]
    part, offset, h = part[use], offset[use], h[use]
    if not len(part):
        return part, offset, np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = np.concatenate([text[:, 1:], np.full((n, SPAN), PAD, np.int16)], axis=1)
    rest = wide[part[:, None], offset[:, None] + np.arange(LEAST, SPAN)]  # what follows the first LEAST bytes
    order = np.lexsort([*rest.T[::-1], h])
    part, offset, h, rest = part[order], offset[order], h[order], rest[order]
    head = wide[part[:, None], offset[:, None] + np.arange(LEAST)]
    alike = np.append(False, (h[1:] == h[:-1]) & (head[1:] == head[:-1]).all(axis=1))
    equal = np.vstack([np.zeros((1, SPAN - LEAST), bool), (rest[1:] == rest[:-1]) & (rest[1:] != PAD)])
    lcp = np.where(alike, LEAST + np.minimum.accumulate(equal, axis=1).sum(axis=1), 0)
    return part, offset, lcp, text[part, offset].astype(np.int64)


def intervals(lcp: np.ndarray, doc: np.ndarray, left: np.ndarray):
    """The common-prefix interval tree by a scan with a stack: (first, last, length, smallest document) of
    each interval of length LEAST or more with several documents whose left bytes differ or are missing."""
    out = []
    stack: list[list] = []  # length, first, smallest, largest document, left byte (-2: they differ)
    lcp, docs, lefts = lcp.tolist(), doc.tolist(), left.tolist()
    n = len(lcp)
    for i in range(1, n + 1):
        length = lcp[i] if i < n else 0
        d, b = docs[i - 1], lefts[i - 1]
        carried = [length, i - 1, d, d, b if b >= 0 else -2]
        while stack and stack[-1][0] > length:
            top = stack.pop()
            if carried[2] < top[2]:
                top[2] = carried[2]
            if carried[3] > top[3]:
                top[3] = carried[3]
            if carried[4] != top[4]:
                top[4] = -2
            if top[4] == -2 and top[2] != top[3]:
                out.append((top[1], i - 1, top[0], top[2]))
            carried = [length, *top[1:]]
        if length:
            if stack and stack[-1][0] == length:
                top = stack[-1]
                if carried[2] < top[2]:
                    top[2] = carried[2]
                if carried[3] > top[3]:
                    top[3] = carried[3]
                if carried[4] != top[4]:
                    top[4] = -2
            else:
                stack.append(carried)
    return out


def covered(parts: list[bytes], doc: np.ndarray) -> np.ndarray:
    """For each byte of each part, whether a repeat that an earlier document holds covers it."""
    part, offset, lcp, left = suffix_array(parts)
    steps = np.zeros((len(parts), SPAN + 1), np.int32)
    found = intervals(lcp, doc[part], left)
    if found:
        first, last, length, smallest = np.array(found, np.int64).T
        sizes = last - first + 1
        at = np.repeat(first - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        length, smallest = np.repeat(length, sizes), np.repeat(smallest, sizes)
        later = doc[part[at]] > smallest
        at, length = at[later], length[later]
        np.add.at(steps, (part[at], offset[at]), 1)
        np.add.at(steps, (part[at], offset[at] + length), -1)
    return np.cumsum(steps, axis=1)[:, :SPAN] > 0


def span_rows(flags: np.ndarray):
    """Row, start and end of each run of True."""
    padded = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    change = np.diff(padded, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1]


def array_spans(texts: DataFrame) -> DataFrame:
    """doc, context, start, end (from the gram's start): covered spans within contexts."""
    rows = texts.repartition("gram").sortWithinPartitions("gram")

    def run(batches):
        for (gram, context, doc, before, raw), _ in in_runs(batches, ["gram", "context", "doc", "before", "bytes"], rows=20_000, most=4 * HOT):
            row, start, end = span_rows(covered(raw.tolist(), doc))
            shift = before[row]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(context[row]), pa.array((start - shift).astype(np.int32)), pa.array((end - shift).astype(np.int32))],
                                             ["doc", "context", "start", "end"])

    return rows.mapInArrow(run, "doc long, context long, start int, end int")


def hot_spans(texts: DataFrame) -> DataFrame:
    """The same for grams with very many contexts: each string of LEAST bytes is dealt on its own."""
    starts = F.explode(F.sequence(F.lit(1), F.length("bytes") - LEAST + 1)).alias("i")
    each = texts.where(F.length("bytes") >= LEAST).select("doc", "context", "before", "bytes", starts)
    each = each.withColumn("s", F.expr(f"substring(bytes, i, {LEAST})")).withColumn("start", F.col("i") - 1 - F.col("before"))
    least = each.groupBy("s").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    return each.join(least, "s").where("doc > least").select("doc", "context", F.col("start").cast("int"), (F.col("start") + LEAST).cast("int").alias("end"))


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def copies_of(docs: DataFrame) -> DataFrame:
    """(_key, _sha) of the rows of LEAST bytes or more whose whole text a smaller key has too."""
    same = docs.where(F.octet_length("_text") >= LEAST).select("_key", sha(F.col("_text")).alias("_sha"))
    firsts = same.groupBy("_sha").agg(F.min("_key").alias("first"), F.max("_key").alias("last")).where("first < last").select("_sha", "first")
    firsts = written(firsts, "suffix-firsts")
    few = firsts.count() <= BROADCAST_COPIES
    return written(same.join(F.broadcast(firsts) if few else firsts, "_sha").where("_key > first").select("_key", "_sha").distinct(), "suffix-copies")


def marks_of(docs: DataFrame, copies: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, _marks: contexts, starts and ends of what to remove, of all but copies."""
    spark = docs.sparkSession
    unique = docs.withColumn("_sha", sha(F.col("_text"))).join(copies, ["_key", "_sha"], "left_anti").select("_key", "_text")
    found = written(candidates(anchor_rows(unique)), "suffix-candidates")
    free(spark)
    texts = written(context_texts(docs, found.where("lead").select("doc", "context")), "suffix-contexts")
    free(spark)
    many = texts.groupBy("gram").count().where(F.col("count") > hot).select("gram")  # at most rows / hot
    spans = array_spans(texts.join(F.broadcast(many), "gram", "left_anti"))
    if not many.isEmpty():
        spans = spans.unionByName(hot_spans(texts.join(F.broadcast(many), "gram", "left_semi")))
    whole = found.where(~F.col("lead")).select("doc", "context", F.lit(-SIDE).alias("start"), F.lit(LEAST).alias("end"))
    return spans.unionByName(whole).groupBy("doc").agg(F.collect_list(F.struct("context", "start", "end")).alias("_marks"))


def removal(data: bytes, marks) -> list[tuple[int, int]]:
    """Maximal spans to remove, from a document's marks."""
    context, start, end = marks
    step = np.zeros(len(data) + 1, np.int32)
    at, _, own = anchors(data)
    own = own.view(np.int64)
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], context, "left"), np.searchsorted(own[order], context, "right")
    sizes = hi - lo
    index = np.repeat(lo - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    p = at[order[index]]
    np.add.at(step, np.clip(p + np.repeat(start, sizes), 0, len(data)), 1)
    np.add.at(step, np.clip(p + np.repeat(end, sizes), 0, len(data)), -1)
    change = np.diff(np.concatenate([[0], np.cumsum(step)[:-1] > 0, [0]]).astype(np.int8))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """df with `kept` (binary, what is left of each text), n_bytes, n_removed and n_spans instead of text."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    copies = copies_of(docs)
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    made = ["kept", "n_bytes", "n_removed", "n_spans"]
    lent = {c: f"_c{i}" for i, c in enumerate(df.columns) if c not in made}  # so that no name clashes with those used here
    rest = [n for c, n in lent.items() if c != text]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in lent.items()])
    rows = rows.withColumn("_key", F.col(lent[key]).cast("long")).withColumn("_sha", sha(F.coalesce(lent[text], F.lit(""))))
    rows = rows.join(copies.withColumn("_gone", F.lit(True)), ["_key", "_sha"], "left")
    rows = rows.join(marks_of(docs, copies, hot).withColumnRenamed("doc", "_key"), "_key", "left").select(*lent.values(), "_gone", "_marks")
    schema = rows.select(*rest, F.lit(b"").alias("kept"), *[F.lit(0).cast("long").alias(c) for c in made[1:]]).schema

    def run(batches):
        for batch in batches:
            texts, copied, marked = batch.column(lent[text]).to_pylist(), batch.column("_gone").to_pylist(), batch.column("_marks")
            kept, sizes, gone, spans = [], [], [], []
            for i, t in enumerate(texts):
                data = (t or "").encode()
                found = [(0, len(data))] if copied[i] else []
                if marked[i].is_valid and not found:
                    values = marked[i].values
                    found = removal(data, [values.field(c).to_numpy(zero_copy_only=False) for c in ("context", "start", "end")])
                left, at = [], 0
                for s, e in found:
                    left.append(data[at:s])
                    at = e
                kept.append(b"".join([*left, data[at:]]))
                sizes.append(len(data))
                gone.append(len(data) - len(kept[-1]))
                spans.append(len(found))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, gone, spans)]], [*rest, *made])

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in lent.items() if c != text], *made)


def as_text(df: DataFrame, kept: str = "kept", text: str = "text") -> DataFrame:
    """Adds `text`, the kept bytes as a string; bytes of characters that a cut has split are left out."""
    schema = df.select(*[c for c in df.columns if c not in (kept, text)], F.lit("").alias(text)).schema

    def run(batches):
        for batch in batches:
            strings = [None if b is None else b.decode("utf-8", "ignore") for b in batch.column(kept).to_pylist()]
            rest = [c for c in schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(strings, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

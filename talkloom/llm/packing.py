"""Best-fit packing of token pieces into sequences, with swap-based local search.

Pieces are dealt into groups of about GROUP rows by a hash of their key; the search empties more bins in groups of
thousands than of tens of thousands.  In a group: best fit, longest first; then, while the bins exceed the lower bound ceil(tokens / capacity), the emptiest bin gives its
pieces away by moves, one-for-one and two-for-one exchanges that each raise the sum of squared fills,
until bins empty or no exchange helps.  Then each group opens its emptiest bins again, of GROUP / FAN pieces
at most, and FAN groups' pieces meet in one group, round by round, so that what no group could place well is
packed across groups and no group ever holds more than about GROUP pieces.

Edge cases: null length counts as 0; a piece longer than the capacity is an error (cut before packing);
an empty table gives an empty table; repeated rows are packed each on its own; other columns stay; a null key is one
more key, and integer keys keep their digits beside it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

GROUP = 4_000
FAN = 16  #: groups that meet in one group of the next round


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; `free` is a bit set of the free room that some bin has."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    free = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                free &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        by_room.setdefault(room - n, []).append(at)
        free |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search between underfull bins.  The emptiest gives its items away: by moves to the tightest room,
    else by the exchange, one for one or two for one, that adds most to a fuller bin; each raises the sum of
    squared fills, so the search ends by itself.  A bin that no change empties further stays as it is."""
    size = np.array(lengths, np.int64)
    need = -(-int(size.sum()) // capacity)
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    home = np.zeros(len(size), np.int64)
    for k, b in enumerate(bins):
        home[b] = k
    is_open = fill < capacity
    left = sum(1 for b in bins if b)

    def put(i: int, to: int) -> None:
        at = home[i]
        bins[at].remove(i)
        bins[to].append(i)
        home[i] = to
        fill[at] -= size[i]
        fill[to] += size[i]

    while left > need and is_open.sum() > 1:
        at = np.flatnonzero(is_open)
        src = int(at[np.argmin(fill[at])])
        is_open[src] = False
        at = at[at != src]
        while bins[src]:
            moved = False
            for a in sorted(bins[src], key=lambda i: -lengths[i]):
                room = capacity - fill[at]
                fits = np.where(room >= size[a], room, capacity + 1)
                if fits.min() <= capacity:
                    put(a, int(at[np.argmin(fits)]))
                    moved = True
            if moved:
                continue
            own = np.array(sorted(bins[src], key=lambda i: lengths[i]))
            one, two = np.triu_indices(len(own))  # a pair of an item with itself stands for the item alone
            give = size[own[one]] + np.where(one == two, 0, size[own[two]])
            order = np.argsort(give, kind="stable")
            other = np.flatnonzero(is_open[home])
            slack = capacity - fill[home[other]]
            best = np.searchsorted(give[order], size[other] + slack, side="right") - 1  # the most that fits in its place
            gain = np.where(best >= 0, give[order][best] - size[other], 0)
            gain = np.where(fill[home[other]] + gain > fill[src], gain, 0)
            if not len(gain) or gain.max() <= 0:
                break
            b = int(np.argmax(gain))
            to, pick = int(home[other[b]]), int(order[best[b]])
            put(int(other[b]), src)
            for i in {int(own[one[pick]]), int(own[two[pick]])}:
                put(i, to)
        left -= not bins[src]
        is_open &= fill < capacity
    return [b for b in bins if b]


def pack(df: DataFrame, keys: list[str], length: str = "length", capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to each row of df; keys name columns that tell rows apart."""
    rest = [c for c in df.columns if c not in ("sequence_id", "offset")]
    df = df.select(*rest)
    rows = df.count()
    groups = max(1, -(-rows // group))
    schema = df.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                       F.lit(False).alias("_open"), F.lit(0).cast("long").alias("_group")).schema
    done, turn = None, 0
    names = schema.names
    todo = df.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("long"))
    while True:
        last = groups == 1

        def run(rows: pa.Table) -> pa.Table:  # pickled before turn and last change
            rows = rows.take(pc.sort_indices(rows, [(k, "ascending") for k in keys])) if len(rows) else rows
            sizes = pc.fill_null(rows[length].cast(pa.int64()), 0)
            if len(rows) and pc.max(sizes).as_py() > capacity:
                raise ValueError(f"a piece is longer than {capacity}")
            sizes = sizes.to_pylist()
            bins = improve(best_fit(sizes, capacity), sizes, capacity)
            number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            again = np.zeros(len(sizes), bool)
            base = (turn << 58) | (rows["_group"][0].as_py() << 22)
            for j, b in enumerate(bins):
                at = 0
                for i in b:
                    number[i], offset[i] = base + j, at
                    at += sizes[i]
            room = 0 if last else group // FAN
            for b in sorted(bins, key=lambda b: sum(sizes[i] for i in b)):
                room -= len(b)
                if room < 0 or sum(sizes[i] for i in b) >= capacity:
                    break
                again[b] = True
            made = {"sequence_id": number, "offset": offset, "_open": again}
            return pa.table({n: pa.array(made[n]) if n in made else rows[n] for n in names})

        packed = written(todo.groupBy("_group").applyInArrow(run, schema), "packed")
        full = packed.where("not _open").select(*rest, "sequence_id", "offset")
        done = full if done is None else done.unionByName(full)
        if last:
            return done
        groups, turn = -(-groups // FAN), turn + 1
        todo = packed.where("_open").select(*rest, F.floor(F.col("_group") / FAN).cast("long").alias("_group"))


def pieces(df: DataFrame, path: str, capacity: int = 4096, end: int = 1, text: str = "text", key: str = "doc_id",
           forget: bool = False) -> DataFrame:
    """Ids of each text and the id `end`, cut every `capacity` ids:
    key, piece, start, length, ids_crc32 and the ids themselves.  forget: each task frees its memo of words,
    at some cost in time, so that the worker's memory is free for other steps of the same application."""
    schema = f"{key} {dict(df.dtypes)[key]}, piece int, start long, length long, ids_crc32 long, ids array<int>"
    names = [key, "piece", "start", "length", "ids_crc32", "ids"]
    tail = int(end).to_bytes(4, "little")

    def run(batches):
        from .word_bpe import coder

        words = coder(path)
        for batch in batches:
            all_texts, all_keys = batch.column(1).to_pylist(), batch.column(0)
            for lo in range(0, len(all_texts), 512):
                raws = words.encode(all_texts[lo : lo + 512])
                owner, piece, start, crc, parts = [], [], [], [], []
                for i, raw in enumerate(raws):
                    raw += tail
                    for p, s in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[s : s + 4 * capacity]
                        owner.append(lo + i)
                        piece.append(p)
                        start.append(s // 4)
                        crc.append(zlib.crc32(part))
                        parts.append(part)
                sizes = [len(x) // 4 for x in parts]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum(sizes, out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
                yield pa.RecordBatch.from_arrays([all_keys.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                                  pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()), ids], names)
        if forget:
            words.forget()

    return df.select(key, text).mapInArrow(run, schema)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, forget: bool = False) -> DataFrame:
    import public_tokenizers as P

    cut = written(pieces(docs, P.path("word_bpe_49k.json"), forget=forget).drop("ids"), "pieces")
    return pack(cut, ["doc_id", "piece", "start"])

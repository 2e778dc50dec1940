"""Byte-level BPE encoding and decoding by a rank file.

Method: a segment tree over the byte positions of a piece holds, in each node, the smallest rank of a
neighbouring pair below it; the leftmost leaf with the root's rank is merged, and the merge updates
three leaves (the pair itself, its live left neighbour, the swallowed right one) and their paths.
Short pieces run through many trees at once in numpy, one row per piece; long ones through one tree.

Edge cases: null and empty texts give no ids; any other text, however long, is encoded whole; a byte
sequence that is one token takes that token without merging, as the public libraries do.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.uint32(0xFFFFFFFF)
MEMO_ENTRIES = 350_000


class PairMerger:
    """Merges by segment tree.  pairs: (left id << 32 | right id) to the merged id, lower ids first;
    first: the id of each single byte; last: that of a byte which ends its piece."""

    def __init__(self, pairs: dict[int, int], first: np.ndarray, last: np.ndarray):
        self.pair_dict, self.byte, self.last = pairs, first, last
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1 << 62))
        self.vals = np.append(np.fromiter(pairs.values(), np.uint32, len(pairs))[order], NONE)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        i = np.searchsorted(self.keys, key)
        return np.where(self.keys[i] == key, self.vals[i], NONE)

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Trees of `size` leaves, one row per piece (each of 2..size bytes)."""
        n, rows = len(pieces), np.arange(len(pieces))
        length = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.zeros((n, size + 1), np.uint8)
        where = np.arange(size + 1) < length[:, None]
        raw[where] = np.frombuffer(b"".join(pieces), np.uint8)
        tok = self.byte[raw]
        tok[rows, length - 1] = self.last[raw[rows, length - 1]]
        nxt = np.tile(np.arange(1, size + 2), (n, 1))
        prv = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.uint32)
        first = self.pairs(tok[:, :-1], tok[:, 1:])
        first[np.arange(size) + 1 >= length[:, None]] = NONE
        tree[:, size:] = first
        node = size
        while node > 1:
            tree[:, node // 2 : node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node //= 2
        live = where.copy()
        act = rows[tree[:, 1] != NONE]
        while len(act):
            best = tree[act, 1]
            at = np.ones(len(act), np.int64)
            for _ in range(size.bit_length() - 1):
                at = 2 * at
                at += tree[act, at] != best
            p = at - size
            q = nxt[act, p]
            after, before = nxt[act, q], prv[act, p]
            tok[act, p] = best
            live[act, q] = False
            nxt[act, p] = after
            inside = after < length[act]
            prv[act[inside], after[inside]] = p[inside]
            self._set(tree, act, q, np.full(len(act), NONE), size, length)
            new = np.full(len(act), NONE)
            new[inside] = self.pairs(tok[act[inside], p[inside]], tok[act[inside], after[inside]])
            self._set(tree, act, p, new, size, length)
            has = before >= 0
            if has.any():
                rest, b = act[has], before[has]
                self._set(tree, rest, b, self.pairs(tok[rest, b], tok[rest, p[has]]), size, length)
            act = act[tree[act, 1] != NONE]
        flat = tok[live].astype("<i4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def _set(tree, rows, leaf, value, size, length) -> None:
        at = leaf + size
        ok = leaf < size
        if not ok.all():
            rows, at, value = rows[ok], at[ok], value[ok]
        tree[rows, at] = value
        while len(at) and at[0] > 1:
            at = at // 2
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

    def merge_one(self, piece: bytes) -> list[int]:
        """One tree, for a long piece."""
        get, n = self.pair_dict.get, len(piece)
        size = 1 << (n - 1).bit_length()
        none = int(NONE)
        tok = [*(int(self.byte[b]) for b in piece[:-1]), int(self.last[piece[-1]])]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = get(tok[i] << 32 | tok[i + 1], none)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, value: int) -> None:
            at = leaf + size
            tree[at] = value
            at >>= 1
            while at:
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1

        while tree[1] != none:
            best, at = tree[1], 1
            while at < size:
                at *= 2
                at += tree[at] != best
            p = at - size
            q = nxt[p]
            after = nxt[q]
            tok[p], tok[q], nxt[p] = best, -1, after
            put(q, none)
            if after < n:
                prv[after] = p
                put(p, get(best << 32 | tok[after], none))
            else:
                put(p, none)
            if prv[p] >= 0:
                put(prv[p], get(tok[prv[p]] << 32 | best, none))
        return [t for t in tok if t >= 0]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each non-empty piece, as raw little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_size.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for size, at in by_size.items():
            if size > 64:
                for i in at:
                    out[i] = np.array(self.merge_one(pieces[i]), "<i4").tobytes()
                continue
            step = max(64, (1 << 18) // size)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                for i, ids in zip(part, self.merge_many([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out


class Memo:
    """A bounded dictionary in two generations: what is still in use moves back on its next use."""

    def __init__(self, entries: int):
        self.entries, self.now, self.old = entries, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.entries:
            self.now, self.old = {}, self.now

    def missing(self, keys: set) -> list:
        """Keys in neither generation; those only in the older one are moved."""
        new = [k for k in keys if k not in self.now]
        if self.old:
            self.now.update(found := {k: self.old[k] for k in new if k in self.old})
            new = [k for k in new if k not in found]
        return new


class Ranks(PairMerger):
    """A rank file: token bytes by id, and the rank of each pair of tokens whose join is a token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.source, self.pattern = pattern, regex.compile(pattern)
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        pairs = {}
        for token, r in self.rank.items():
            self.bytes[r] = token
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        byte = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (byte < 0).any():
            raise ValueError("the rank file lacks single bytes")
        super().__init__(pairs, byte, byte)
        self.raw = [i.to_bytes(4, "little") for i in range(size)]
        self.chunks = Memo(MEMO_ENTRIES)

    def learn(self, chunks: list[str]) -> None:
        """Adds chunks (text that the pattern never matches across) to the memo."""
        split = [self.pattern.findall(c) for c in chunks]
        known = list({p for ps in split for p in ps})
        plain = [p.encode() for p in known]
        ids = {p: self.raw[self.rank[b]] for p, b in zip(known, plain, strict=True) if b in self.rank}
        rest = [(p, b) for p, b in zip(known, plain, strict=True) if b not in self.rank]
        ids.update(zip([p for p, _ in rest], self.merge([b for _, b in rest]), strict=True))
        memo = self.chunks.now
        for c, ps in zip(chunks, split, strict=True):
            memo[c] = b"".join([ids[p] for p in ps])


#: A single blank between two other characters always starts a match of public_tokenizers.PATTERN, so texts are
#: cut there; under another pattern a text is one chunk.
CUT = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict[tuple[str, str], Ranks] = {}


def ranks(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Ranks(path, pattern)
    return _LOADED[path, pattern]


def chunks_of(text: str, pattern: str) -> list[str]:
    import public_tokenizers as P

    if pattern != P.PATTERN:
        return [text]
    parts = text.split(" ")
    if "" in parts:
        parts = CUT.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] or len(parts) > 1 else []


def encode_texts(coder: Ranks, texts: list[str]) -> list[bytes]:
    coder.chunks.turn()
    split = [chunks_of(t, coder.source) if t else [] for t in texts]
    if new := coder.chunks.missing({c for cs in split for c in cs}):
        coder.learn(new)
    memo = coder.chunks.now
    return [b"".join([memo[c] for c in cs]) for cs in split]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `out` array<int>, the ids of `text`.  The text column is replaced by the ids to save a copy."""
    keep = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*keep, F.lit(None).cast("array<int>").alias(out)).schema

    def run(batches):
        coder = ranks(path, pattern)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for at in range(0, len(texts), 512):
                raw = encode_texts(coder, texts[at : at + 512])
                offsets = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                part = batch.slice(at, len(raw))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], [*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out` binary, the joined bytes of the tokens in `ids`."""
    df = df.select(*[c for c in df.columns if c != out])
    schema = df.select("*", F.lit(None).cast("binary").alias(out)).schema

    def run(batches):
        coder = ranks(path, pattern)
        for batch in batches:
            column = batch.column(ids)
            bounds = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            made = []
            for i in range(len(batch)):
                got = flat[bounds[i] : bounds[i + 1]]
                made.append(b"".join([coder.bytes[t] for t in got.tolist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .common import table

    path = P.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, P.PATTERN)
    plain = decode(coded, path, P.PATTERN)
    return plain.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

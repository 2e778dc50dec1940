"""Ids of a lower-casing word BPE file of the `tokenizers` library, for whole columns of texts.

The file normalises (NFC, lower case), drops white space and never merges across it, so each distinct
blank-free word is encoded once per worker and kept in a bounded memo; the merges run in the segment
trees of byte_bpe.  Texts with characters on which the libraries could differ (special tokens, control
characters, the Greek capital sigma) go to the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

from .byte_bpe import Memo, PairMerger

ODD = re.compile("[\x1c-\x1f\x85Σ]|<\\|")
WORD_ENTRIES = 300_000


class WordCoder(PairMerger):
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        pairs, before = {}, -1
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[a + b]
            if made < before:
                raise ValueError("merged ids must rise with the merge order")
            pairs.setdefault(vocab[a] << 32 | vocab[b], made)
            before = made
        super().__init__(pairs, np.array([vocab[char[b]] for b in range(256)]), np.array([vocab[char[b] + end] for b in range(256)]))
        self.words, self.pieces = Memo(WORD_ENTRIES), Memo(WORD_ENTRIES)

    def forget(self) -> None:
        """Frees the memos at the end of a task: the worker process lives on and may do other work."""
        self.words, self.pieces = Memo(WORD_ENTRIES), Memo(WORD_ENTRIES)

    def split(self, word: str) -> list[str]:
        if word.isalpha():
            return [word]
        if word[-1] in ",." and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pattern.findall(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as raw little-endian 32-bit integers."""
        self.words.turn()
        self.pieces.turn()
        odd = {i for i, t in enumerate(texts) if t and ODD.search(t)}
        split = [[] if not t or i in odd else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split() for i, t in enumerate(texts)]
        new = self.words.missing({w for ws in split for w in ws})
        if new:
            cut = [self.split(w) for w in new]
            if fresh := self.pieces.missing({p for ps in cut for p in ps}):
                self.pieces.now.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
            known = self.pieces.now
            self.words.now.update((w, b"".join([known[p] for p in ps])) for w, ps in zip(new, cut, strict=True))
        memo = self.words.now
        out = [b"".join([memo[w] for w in ws]) for ws in split]
        for i in odd:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


_LOADED: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _LOADED:
        _LOADED[path] = WordCoder(path)
    return _LOADED[path]

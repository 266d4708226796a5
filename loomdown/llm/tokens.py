"""Token ids of texts with a public tokenizer, a whole batch at a time."""

from __future__ import annotations

import json
import os
import re
import threading
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import byte_view

#: Lower-case letters that are alone under NFC.
LETTERS = "^[a-zß-öø-ÿ]+$"
#: Of a byte: 1 an ASCII letter, 2 a sign that neither begins a contraction nor belongs to an added token, 3 the end of a letter from À to ÿ, if 0xC3 is before it.
KINDS = np.zeros(256, np.uint8)
KINDS[[b for b in range(128) if chr(b).isalpha()]] = 1
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = 2
KINDS[[b for b in range(128, 192) if b not in (0x97, 0xB7)]] = 3
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, so that a text's ids are those of its words in turn.

    Words that are new to this object are encoded by the tokenizers library, many in one text, whose offsets tell to which word
    each id belongs. Up to `memory` words are remembered from batch to batch, and those met first go when these are full.
    That a tokenizer qualifies is checked on construction: its pre-tokenizer removes what it splits at and its added
    tokens take no white space with them.

    If it lower-cases, splits letters from signs and marks the ends of words as the vocabulary of 49,408 does (checked), then texts are
    cut before signs too, and words of plain letters are encoded by the same model without the patterns, which find nothing in them.
    """

    def __init__(self, path: str, memory: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.ids(["ab cd  \t\n"])[0].tolist() != np.concatenate(self.ids(["ab", "cd"])).tolist():
            raise ValueError("this tokenizer keeps white space; encode whole texts instead")
        self.ends = self.plain_ends(path)
        if self.ends is not None:
            from tokenizers import pre_tokenizers as pre

            self.plain, self.ascii = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre.Sequence([pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ascii.pre_tokenizer = pre.WhitespaceSplit()  # these letters are themselves at the level of bytes
        self.memory = memory
        self.known = pa.array([], pa.large_string())
        self.flat, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    @staticmethod
    def plain_ends(path: str) -> np.ndarray | None:
        """Which ids end a word; None if the tokenizer is not of the kind that letters and signs can be taken apart for."""
        with open(path, encoding="utf-8") as f:
            facts = json.load(f)
        model, normal, first = facts["model"], facts["normalizer"] or {}, ((facts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        suffix = model.get("end_of_word_suffix")
        split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        # No sign of KINDS is in an added token.
        if not suffix or model["type"] != "BPE" or normal.get("normalizers") != NORMAL or first != split or any(not re.fullmatch(r"<\|[a-z]+\|>", t["content"]) for t in facts["added_tokens"]):
            return None
        ends = np.zeros(1 + max(model["vocab"].values()), bool)
        ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        return ends

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word_ids(self, words: list[str], together: int = 200) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        coded = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.uint32)
        begin = np.fromiter((o[0] for e in coded for o in e.offsets), np.int64, len(ids))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        base = np.concatenate(([0], np.cumsum(lengths)))
        begin += np.repeat(base[:-1:together], [len(e.ids) for e in coded])
        return ids, np.bincount(np.searchsorted(base, begin, "right") - 1, minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        # As str.split() does, but only at the separators that the tokenizer's own \s has too.
        words = pc.ascii_split_whitespace(self.opened(pa.array([t or "" for t in texts], pa.large_string())))
        per_text = np.diff(words.offsets.to_numpy())
        coded = pc.dictionary_encode(words.flatten())
        index = self.numbers(coded.dictionary)[coded.indices.to_numpy()]
        sizes = np.diff(self.bounds)[index]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[index] - (ends - sizes), sizes)
        text_ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))]
        return self.flat[at], np.diff(text_ends)

    def opened(self, texts: pa.Array) -> pa.Array:
        """Texts with the same ids and fewer different words: A-Z in lower case, and a blank before a sign behind a letter, where the tokenizer's pattern always splits."""
        data, ends = byte_view(texts)
        if self.ends is None or len(data) < 3:
            return texts
        if b"<|" not in data.tobytes():  # added tokens go by their case
            # A letter before a mark stays, as some have a form of one character with the mark in lower case alone.
            data = data.copy()
            data[:-1] |= ((data[:-1] - np.uint8(65) < 26) & (data[1:] < 128)).view(np.uint8) << np.uint8(5)
        kind = KINDS[data]
        cuts = np.flatnonzero(kind == 2)
        cuts = cuts[cuts > 1]
        before = kind[cuts - 1]
        cuts = cuts[(before == 1) | (before == 3) & (data[cuts - 2] == 0xC3)]
        data, ends = np.insert(data, cuts, 32), ends + np.searchsorted(cuts, ends)
        return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each of these different words among the remembered ones."""
        if len(self.known) + len(words) > self.memory and len(self.known) > self.memory // 2:
            first = len(self.known) - self.memory // 2
            self.known = pa.concat_arrays([self.known[first:]])
            self.flat, self.bounds = self.flat[self.bounds[first] :], self.bounds[first:] - self.bounds[first]
        at = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = words.take(new)
            plain = ascii = np.zeros(len(words), bool)
            if self.ends is not None:
                plain = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
                ascii = plain & pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
            for which, coder in ((ascii, self.ascii_ids), (plain & ~ascii, self.plain_ids), (~plain, self.word_ids)):
                some = words.filter(which)
                at[new[which]] = len(self.known) + np.arange(len(some))
                if len(some):
                    self.store(some, *coder(some.to_numpy(zero_copy_only=False).tolist()))
        return at

    def store(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, words])
        self.flat = np.concatenate([self.flat, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def ascii_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.plain_ids(words, coder=self.ascii)

    def plain_ids(self, words: list[str], together: int = 200, coder=None) -> tuple[np.ndarray, np.ndarray]:
        """As word_ids, of words of lower-case letters alone: each ends with the only one of its ids that ends a word."""
        groups = [" ".join(words[i : i + together]) for i in range(0, len(words), together)]
        coded = (coder or self.plain).encode_batch_fast(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in coded])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self.word_ids(words, together)
        return ids, np.diff(ends, prepend=0)


def pieces(texts: list[str | None], chars: int = 1_000_000) -> Iterator[slice]:
    """Slices of the list with about `chars` characters each, to bound what is in memory at once."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


_encoders: dict[str, WordEncoder] = {}
_lock = threading.Lock()


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and tokenizer."""
    with _lock:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        return _encoders[path]

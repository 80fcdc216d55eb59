"""Whole texts to token ids with a public tokenizer file, encoding each distinct chunk of a task once.

A chunk is what the tokenizer's own pre-splitting never joins to its neighbours, so the ids of a text are
the ids of its chunks in order:

* ``spaced`` (byte-level BPE; a space belongs to the word after it): chunks are words with the space before
  them, and single newlines. Where a text has other white space, or more of it in a row, they are words with
  the one character of white space before them, and what white space is left.
* ``bare`` (white space is dropped): chunks are runs without ASCII white space.

Texts that hold one of the tokenizer's special strings are encoded whole, as these are cut out first.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"

# The characters with the Unicode property White_Space.
_SPACES = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
#: What the simple split can't do: the mark it uses, other white space, and white space in a row.
_RARE = ("\0", "  ", "\n\n", " \n", "\n ", *[c for c in _SPACES if c not in " \n"])
_SPACE = re.escape("".join(_SPACES))
_ANY_CHUNK = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+")
_HALF = re.compile("[\ud800-\udfff]")  # half of a surrogate pair, which Arrow doesn't take
_WHITE = re.compile(f"[{_SPACE}]")

# Chunks that plain rules cut as WORD_BPE's own do: letters that no normal form changes, single digits, runs of punctuation without
# apostrophes (which begin endings like 's). Lower-cased first; the letters are ASCII and Latin to U+017E.
_PLAIN = re.compile(r"[a-z\xdf-\xf6\xf8-\u017e0-9!-&(-/:-@\[-`{-~]+")
_PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\u017e]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END = "</w>"


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of texts; it keeps the ids of at most about max_chunks distinct chunks, of the more used ones first."""

    def __init__(self, path: str, spaced: bool, max_chunks: int = 1_200_000, group_chars: int = 1_000_000, join: int = 100):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.max_chunks, self.group_chars, self.join = spaced, max_chunks, group_chars, join
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # What stands between new chunks that are encoded together: its one id marks the cuts.
        self.mark = "\n" if spaced else "\x01"
        self.between = "\n" if spaced else "\n\x01\n"
        (self.mark_id,) = self._whole(self.mark).tolist()
        self.pieces, self.ends = (None, None) if spaced else self._for_pieces(path)
        self.known: defaultdict = defaultdict()
        self._keep([], np.zeros(0, np.int64))

    def _for_pieces(self, path: str) -> tuple:
        """A tokenizer with the same vocabulary that only splits at white space, and which ids end a piece; nothing for files of other rules."""
        from tokenizers import Tokenizer, pre_tokenizers

        own = json.loads(self.tokenizer.to_str())
        normal, cut = own["normalizer"] or {}, own["pre_tokenizer"] or {}
        steps = [x["type"] for x in normal.get("normalizers", [])], [x["type"] for x in cut.get("pretokenizers", [])]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or cut["pretokenizers"][0]["pattern"] != {"Regex": _CUTS} or own["model"].get("end_of_word_suffix") != _END:
            return None, None
        plain = Tokenizer.from_file(path)
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = plain.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(_END)]] = True
        return plain, ends

    def _of_pieces(self, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which of the new chunks consist of plain pieces, their ids one after the other, and how many each has. Each distinct piece is encoded once."""
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        done, cut, counts = [], [], []
        for i, x in enumerate(texts):
            if _PLAIN.fullmatch(x := x.lower()):
                pieces = _PIECE.findall(x)
                done.append(i)
                counts.append(len(pieces))
                cut += [number[p] for p in pieces]
        pieces = list(number)
        number.default_factory = None
        joined = [" ".join(pieces[a : a + self.join]) for a in range(0, len(pieces), self.join)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(got.ids, np.uint32) for got in self.pieces.encode_batch_fast(joined, add_special_tokens=False))])
        ends = np.flatnonzero(self.ends[flat]) + 1
        if len(ends) != len(pieces):  # a vocabulary without some bytes
            return [], flat[:0], np.zeros(0, np.int64)
        sizes = np.diff(ends, prepend=0)
        at = np.array(cut, np.int64)
        n = sizes[at]
        upto = np.cumsum(n)
        ids = flat[np.repeat((ends - sizes)[at] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        return done, ids, np.diff(np.append(0, upto)[np.append(0, np.cumsum(counts, dtype=np.int64))])

    def _keep(self, chunks: list, old: np.ndarray) -> None:
        """Keep these chunks, which had the numbers old."""
        lens = self.lens[old] if len(old) else np.zeros(0, np.int64)
        flat = self._gather(old) if len(old) else np.zeros(0, np.uint32)
        self.known.default_factory = None  # it refers to its owner: such a circle of a million chunks would stay
        self.known = defaultdict(None, zip(chunks, range(len(chunks)), strict=True))
        self.known.default_factory = self.known.__len__
        self.flat, self.lens, self.starts = flat, lens, np.cumsum(lens) - lens
        self.used = np.zeros(len(chunks), np.int64)

    def _forget(self) -> None:
        least = 2
        while np.count_nonzero(self.used >= least) > self.max_chunks // 2:
            least *= 2
        old = np.flatnonzero(self.used >= least)
        chunks = list(self.known)
        self._keep([chunks[i] for i in old.tolist()], old)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        n = self.lens[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _odd(self, text: str) -> list | None:
        """The chunks of a text that _plain() can't split (null: it is encoded whole)."""
        if any(x in text for x in self.special):
            return None
        return _ANY_CHUNK.findall(text) if self.spaced else text.encode("utf-8", "surrogatepass").split()

    def _plain(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The chunks of other texts, and how many each has."""
        found = pa.array(texts, pa.large_string())
        if self.spaced:
            found = pc.split_pattern(pc.replace_substring(pc.replace_substring(found, " ", "\0 "), "\n", "\0\n\0"), "\0")
            return found.flatten(), np.diff(found.offsets.to_numpy())
        found = pc.ascii_split_whitespace(found)
        chunks = found.flatten().cast(pa.large_binary())
        filled = pc.binary_length(chunks).to_numpy() > 0  # white space at an end leaves an empty one
        before = np.append(0, np.cumsum(filled))[found.offsets.to_numpy()]
        return chunks.filter(pa.array(filled)), np.diff(before)

    def _learn(self, new: list) -> None:
        """Ids of new chunks: encoded joined, cut apart at the marks; by themselves chunks that hold a mark, or white space but a space at the start."""
        texts = new if self.spaced else [x.decode("utf-8", "surrogatepass") for x in new]
        done, ids, sizes = self._of_pieces(texts) if self.pieces else ([], np.zeros(0, np.uint32), np.zeros(0, np.int64))
        skip = set(done)
        rest = enumerate(texts) if not skip else ((i, x) for i, x in enumerate(texts) if i not in skip)
        alone = [i for i, x in rest if self.mark in x or not x.strip(" ") or self.spaced and _WHITE.search(x, x[0] == " ")]
        single = skip.union(alone)
        most = [i for i in range(len(texts)) if i not in single]
        joined = [self.between.join([texts[i] for i in most[a : a + self.join]]) for a in range(0, len(most), self.join)]
        parts = [self._whole(texts[i]) for i in alone]
        lens = np.zeros(len(texts), np.int64)
        lens[alone] = [len(x) for x in parts]
        mark = np.array([self.mark_id], np.uint32)
        for got in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            parts += [np.array(got.ids, np.uint32), mark]
        order = np.array(alone + most + done, np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *parts])
        own = int(lens[alone].sum())
        cuts = flat[own:] == self.mark_id
        lens[most] = np.diff(np.flatnonzero(cuts), prepend=-1) - 1
        lens[done] = sizes
        flat = np.concatenate([flat[:own], flat[own:][~cuts], ids])
        starts = np.zeros(len(texts), np.int64)
        starts[order] = len(self.flat) + np.cumsum(lens[order]) - lens[order]
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        self.flat, self.used = np.concatenate([self.flat, flat]), np.concatenate([self.used, np.zeros(len(texts), np.int64)])

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of chunks, new ones included: each distinct one is looked up once, as most of the time goes into finding its place among all that are known."""
        found = chunks.dictionary_encode()
        return np.array([self.known[c] for c in found.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)[found.indices.to_numpy()]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        known, before, rare = self.known, len(self.known), (*self.special, *(_RARE if self.spaced else ()))
        odd = {i: self._odd(x) for i, x in enumerate(texts) if any(r in x for r in rare) or not x.isascii() and _HALF.search(x)}
        chunks, lens = self._plain([x for i, x in enumerate(texts) if i not in odd])
        lens, places, every = iter(lens.tolist()), [], [self._numbers(chunks)]
        at = len(every[0])
        plain = 0
        for i in range(len(texts)):
            if i not in odd:
                n = next(lens)
                places.append(slice(plain, plain + n))
                plain += n
            elif odd[i] is None:
                places.append(None)
            else:
                every.append(np.array([known[c] for c in odd[i]], np.int64))
                places.append(slice(at, at + len(odd[i])))
                at += len(odd[i])
        every = np.concatenate(every)
        if len(known) > before:
            self._learn(list(islice(known, before, None)))
        flat, ends = self._gather(every), np.append(0, np.cumsum(self.lens[every]))
        out = [self._whole(text) if place is None else flat[ends[place.start] : ends[place.stop]] for place, text in zip(places, texts, strict=True)]
        self.used += np.bincount(every, minlength=len(self.used))
        if len(known) > self.max_chunks:
            self._forget()
        return out

    def encode(self, texts: list[str | None]):
        """Yields the ids (uint32) of each text, null as empty."""
        group, size = [], 0
        for text in texts:
            text = text or ""
            group.append(text)
            size += len(text)
            if size >= self.group_chars:
                yield from self._ids(group)
                group, size = [], 0
        if group:
            yield from self._ids(group)


_encoders: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaced: bool, max_chunks: int = 1_200_000, group_chars: int = 1_000_000) -> ChunkEncoder:
    """The worker's encoder; Spark reuses Python workers, so what one task has learnt helps the next."""
    key = (path, spaced, max_chunks, group_chars)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(*key)
    return _encoders[key]


def release() -> None:
    """Drops the worker's encoders: Spark reuses Python workers, and what follows may need the memory."""
    while _encoders:
        _encoders.popitem()[1].known.default_factory = None
    pa.default_memory_pool().release_unused()

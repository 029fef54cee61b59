"""Token ids of many texts at once.

The tokenizers library encodes every distinct piece of text once and numpy puts
the ids of the pieces in place: byte-level BPE never merges across the pieces
its pre-tokenizer cuts, so this gives exactly what encoding each whole text
does, at several times the speed. Pieces are cut with the pre-tokenizer's rule:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A tokenizer file whose pre-tokenizer is another one is encoded text by text, and
so are texts that hold an added token such as ``<|endoftext|>`` literally: the
library looks for those before it cuts pieces.
Pieces met are remembered by a worker, up to ``PIECES``.
"""

from __future__ import annotations

import json
import os
import sys
import types

import numpy as np
import public_tokenizers
import regex

from . import words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = 600_000
SPACE, LETTER, NUMBER, OTHER = range(4)


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((SPACE, r"\p{White_Space}+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            points = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            out[points] = kind
    return out


def pieces(code: np.ndarray, begin: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces begin. code: code points of all texts; begin: where texts begin, and the end."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[code]
    edge = np.zeros(n + 1, bool)  # runs of one class in one text
    edge[1:n] = kind[1:] != kind[:-1]
    edge[begin] = True
    run = np.flatnonzero(edge[:n])
    stop = np.append(run[1:], n)
    first = np.zeros(n + 1, bool)
    first[begin] = True
    what = kind[run]
    mark = np.zeros(n + 1, bool)
    # A run of other than white space takes one blank before it along.
    solid = run[what != SPACE]
    joined = (solid > 0) & ~first[solid] & (code[solid - 1] == 32)
    mark[solid - joined] = True
    white, after = run[what == SPACE], stop[what == SPACE]
    ends_text = first[after] | (after == n)
    mark[white[ends_text | (after - white > 1)]] = True
    last = after[~ends_text] - 1
    mark[last[code[last] != 32]] = True
    # 's 't 'm 'd 're 've 'll, where a piece begins with the apostrophe.
    mine = solid[~joined]
    quote = mine[code[mine] == 39]
    if len(quote):
        padded = np.append(code, [0, 0, 0])
        own = lambda k: ~first[np.minimum(quote + k, n)] & (quote + k < n)  # noqa: E731  in the same text
        c1 = np.where(own(1), padded[quote + 1], 0)
        c2 = np.where(own(1) & own(2), padded[quote + 2], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ~one & np.isin(c1 * 65536 + c2, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")])
        mark[quote[one | two] + 1] = False
        mark[quote[one] + 2] = True
        mark[quote[two] + 3] = True
    return np.flatnonzero(mark[:n])


class Coder:
    """Encodes texts with one tokenizer. source: the tokenizer file's content."""

    def __init__(self, source: str, kinds: np.ndarray) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        rule = json.loads(source)
        own = rule.get("pre_tokenizer") or {}
        self.whole = bool(rule.get("normalizer")) or own.get("type") != "ByteLevel" or own.get("add_prefix_space") or not own.get("use_regex", True)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.kinds, self.powers = kinds, words.Powers()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.ones(max(vocabulary.values(), default=0) + 1, np.int64)  # byte-level: a character of an entry is a byte
        for entry, i in vocabulary.items():
            self.bytes_of[i] = len(entry)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _each(self, texts: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Ids of all pieces one after the other, their numbers, and the pieces' order in that.
        plain: pieces of a blank and letters; they are encoded in rows, as the pre-tokenizer cuts rows of
        them where they meet, and told apart by the bytes that each id stands for."""
        ids, counts, order = [], [], np.flatnonzero(plain).tolist()
        if any(" " in a[1:] for a in self.added):  # one could arise where pieces meet
            order = []
            plain = np.zeros(len(texts), bool)
        groups = [order[i : i + 256] for i in range(0, len(order), 256)]
        coded = self.tokenizer.encode_batch_fast(["".join([texts[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, coded, strict=True):
            own = np.array(e.ids, np.uint32)
            ends = np.cumsum(self.bytes_of[own])
            cuts = np.searchsorted(ends, np.cumsum([len(texts[i].encode()) for i in group]), side="left") + 1
            ids.append(own)
            counts.append(np.diff(cuts, prepend=0))
        rest = np.flatnonzero(~plain).tolist()
        for e in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.array([len(e.ids)]))
        return np.concatenate(ids), np.concatenate(counts), order + rest

    def _learn(self, keys: list[int], texts: list[str], plain: np.ndarray) -> None:
        ids, counts, order = self._each(texts, plain)
        at = len(self.known)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
        while at + len(keys) > len(self.start):
            self.start, self.length = (np.concatenate((x, np.zeros(len(x), np.int64))) for x in (self.start, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[at : at + len(keys)] = self.used + np.cumsum(counts) - counts
        self.length[at : at + len(keys)] = counts
        self.used += len(ids)
        self.known.update(zip([keys[i] for i in order], range(at, at + len(keys)), strict=True))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=out[1:])
        return np.fromiter((i for x in ids for i in x), np.uint32, out[-1]), out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin (and the end)."""
        if self.whole:
            return self._whole(texts)
        special = np.array([any(a in t for a in self.added) for t in texts], bool)
        if not special.any():
            return self._pieced(texts)
        parts = [(np.flatnonzero(special), self._whole), (np.flatnonzero(~special), self._pieced)]
        n = np.zeros(len(texts), np.int64)
        coded = []
        for rows, encoder in parts:
            ids, at = encoder([texts[i] for i in rows])
            n[rows] = np.diff(at)
            coded.append((rows, ids))
        out = np.concatenate(([0], np.cumsum(n)))
        all_ids = np.zeros(out[-1], np.uint32)
        for rows, ids in coded:
            own = n[rows]
            all_ids[np.arange(len(ids)) + np.repeat(out[rows] - (np.cumsum(own) - own), own)] = ids
        return all_ids, out

    def _pieced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(len(texts) + 1, np.int64)
        all_text = "".join(texts)
        code = np.frombuffer(all_text.encode("utf-32-le"), np.uint32)
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=begin[1:])
        at = pieces(code, begin, self.kinds)
        if not len(at):
            return np.zeros(0, np.uint32), out
        end = np.append(at[1:], len(code))
        up, down = self.powers.upto(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint64(1)) * up[: len(code)], out=total[1:])
        h = words.mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(h)
        ordered = h[order]
        fresh = np.r_[True, ordered[1:] != ordered[:-1]]
        some, where = ordered[fresh], order[fresh]
        back = np.empty(len(h), np.int64)
        back[order] = np.cumsum(fresh) - 1
        if len(self.known) + len(some) > max(PIECES, len(some)):
            self.forget()
        keys = some.tolist()
        index = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(index) if x is None]
        if new:
            lo, hi = at[where[new]], end[where[new]]
            plain = (code[lo] == 32) & (hi - lo > 1) & (self.kinds[code[np.minimum(lo + 1, len(code) - 1)]] == LETTER)
            self._learn([keys[i] for i in new], [all_text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], plain)
            for i in new:
                index[i] = self.known[keys[i]]
        piece = np.array(index, np.int64)[back]
        n = self.length[piece]
        before = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[np.arange(before[-1]) + np.repeat(self.start[piece] - before[:-1], n)]
        return ids, before[np.searchsorted(at, begin)]


class Shared:
    """What a task needs to make or find its worker's coder; to be broadcast."""

    def __init__(self, path: str = TOKENIZER) -> None:
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        self.kinds = classes()

    def most_id(self) -> int:
        from tokenizers import Tokenizer

        return max(Tokenizer.from_str(self.source).get_vocab().values(), default=0)

    def coder(self) -> Coder:
        """One for a worker process: tasks after the first find the pieces already known."""
        held = sys.modules.setdefault("_cirrostrat_worker", types.ModuleType("_cirrostrat_worker")).__dict__
        key = ("coder", hash(self.source))
        if key not in held:
            held[key] = Coder(self.source, self.kinds)
        return held[key]

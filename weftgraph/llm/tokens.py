"""Encoding whole texts with the tokenizers library, at the price of their distinct units.

A byte-level BPE first cuts a text by a fixed pattern into units: contractions, runs of
letters, of numbers or of other characters, each with the space before it, and what is
left of white space.  Every unit is encoded on its own.  Here a batch of texts is cut at
once, on arrays of code points; which class a character has is asked of the library when
it is first met.  Arrow makes the units distinct, and the library encodes those that this
process has not met, many in a call.  Texts that hold a special token, and all texts where
the file's pattern is another one, are encoded whole.  Ids are the same.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEEP = 300_000  # units remembered; beyond, those met in one batch only are forgotten
GROUP = 64  # units encoded in one call
PART = 1 << 20  # characters of a text that are cut at once
UNKNOWN, LETTER, NUMBER, OTHER, SPACE, END = range(6)
APOSTROPHE, BLANK = ord("'"), ord(" ")
_encoders: dict[str, Encoder] = {}


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str) -> list[str]:
    """A long text in parts that end before a single space; no unit reaches over one."""
    out, at = [], 0
    while len(text) - at > PART:
        stop = at + PART
        while 0 <= (stop := text.find(" ", stop)) < len(text) - 1 and (text[stop - 1].isspace() or text[stop + 1].isspace()):
            stop += 1
        if not 0 <= stop < len(text) - 1:
            break
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.size = size
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("Ġ")
        self.newline = vocabulary.get("Ċ")
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        before = spec.get("pre_tokenizer") or {}
        self.by_units = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes, self.met = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    # ---- cutting

    def class_of(self, character: str) -> int:
        for kind, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(beside + character)) == 1:
                return kind
        return SPACE

    def cut(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where units start in the code points of several texts; a filler stands after
        each text, at `ends`, and counts as a unit."""
        kind = self.classes[points]
        if not kind.all():
            for p in np.unique(points[kind == UNKNOWN]).tolist():
                self.classes[p] = self.class_of(chr(p))
            kind = self.classes[points]
        kind[ends] = END
        start = np.empty(len(kind), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[ends] = True
        # the last of the white space before a word is a unit, or the word's if it is a blank
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
        start[last] = True
        start[last[points[last] == BLANK] + 1] = False
        # contractions: an apostrophe alone, then these letters
        for i in np.flatnonzero((points == APOSTROPHE) & start).tolist():
            if kind[i + 1] == LETTER:
                a, b = chr(points[i + 1]), chr(points[i + 2]) if kind[i + 2] == LETTER else ""
                n = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
                if n:
                    start[i + 1] = False
                    if kind[i + 1 + n] == LETTER:
                        start[i + 1 + n] = True
        return np.flatnonzero(start)

    # ---- units

    def learn(self, new: list[bytes]) -> None:
        """Append the ids of units to those known."""
        space = {u for u in new if (u.isspace() if u.isascii() else u.decode().isspace())}
        spaced, bare = [u for u in new if u[0] == BLANK and u not in space], [u for u in new if u[0] != BLANK and u not in space]
        groups = [(units[a : a + GROUP], between) for units, between in ((spaced, b""), (bare, b"\n")) for a in range(0, len(units), GROUP)]
        coded = self.tokenizer.encode_batch_fast([between.join(g).decode() for g, between in groups], add_special_tokens=False) if groups else []
        order, held, starts, sizes, size = [], [self.ids], [self.starts], [self.sizes], len(self.ids)

        def add(units, ids, at, to):
            nonlocal size
            order.extend(units)
            held.append(ids)
            starts.append(at + size)
            sizes.append(to - at)
            size += len(ids)

        alone = list(space)
        for (g, between), e in zip(groups, coded):
            ids = np.array(e.ids, self.dtype)
            if between:
                stops = np.flatnonzero(ids == self.newline) if self.newline is not None else np.zeros(0, np.int64)
                at, to = np.r_[0, stops + 1], np.r_[stops, len(ids)]
            else:
                at = np.flatnonzero(self.opens[ids])
                to = np.r_[at[1:], len(ids)]
            if len(at) == len(g) and at[0] == 0:
                add(g, ids, at, to)
            else:  # a unit that holds such a token inside
                alone += g
        for u, ids in zip(alone, self.whole([u.decode() for u in alone])):
            add([u], ids, np.zeros(1, np.int64), np.array([len(ids)]))
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order))))
        self.ids, self.starts, self.sizes = np.concatenate(held), np.concatenate(starts), np.concatenate(sizes)
        self.met = np.r_[self.met, np.zeros(len(order), np.int32)]

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """The places of distinct units among those known, new ones learned."""
        if len(self.known) + len(units) > KEEP:
            often = [u for u, m in zip(self.known, (self.met > 1).tolist()) if m]
            if len(often) > KEEP // 2:
                often = []
            at = np.fromiter(map(self.known.__getitem__, often), np.int64, len(often))
            sizes = self.sizes[at]
            starts = np.cumsum(sizes) - sizes
            self.ids = self.ids[np.repeat(self.starts[at] - starts, sizes) + np.arange(sizes.sum())]
            self.known = dict(zip(often, range(len(often))))
            self.starts, self.sizes, self.met = starts, sizes, np.ones(len(at), np.int32)
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        if len(missing := np.flatnonzero(at < 0)):
            new = [units[i] for i in missing.tolist()]
            self.learn(new)
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.met[at] += 1
        return at

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each text's followed by `end` if that
        is given, and how many ids each text has."""
        if not texts:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        tail = [] if end is None else [end]
        apart = [i for i, t in enumerate(texts) if not self.by_units or any(s in t for s in self.special)]
        if apart:
            coded = dict(zip(apart, self.whole([texts[i] for i in apart])))
            ids, sizes = self.encode([t for i, t in enumerate(texts) if i not in coded], end)
            others = iter(np.split(ids, np.cumsum(sizes)[:-1]))
            out = [np.r_[coded[i], np.array(tail, self.dtype)] if i in coded else next(others) for i in range(len(texts))]
            return np.concatenate(out), np.array([len(x) for x in out], np.int64)
        pieces = [(i, p) for i, t in enumerate(texts) for p in parts(t)]
        joined = "".join(p + "\n" for _, p in pieces)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for _, p in pieces]) - 1
        starts = self.cut(points, ends)
        if len(points) == len(data := joined.encode()):
            offsets = np.r_[starts, len(points)]
        else:
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            offsets = np.r_[0, np.cumsum(width, dtype=np.int64)][np.r_[starts, len(points)]]
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        number = self.numbers(units.dictionary.to_numpy(zero_copy_only=False).tolist())[units.indices.to_numpy()]
        sizes, begin, ids = self.sizes[number], self.starts[number], self.ids
        fill = np.searchsorted(starts, ends)  # the fillers among the units
        sizes[fill] = 0
        if tail:  # the end stands in the place of the filler after a text's last part
            owner = np.array([i for i, _ in pieces])
            final = fill[np.r_[owner[1:] != owner[:-1], True]]
            sizes[final], begin[final], ids = 1, len(ids), np.r_[ids, np.array(tail, self.dtype)]
        stop = np.cumsum(sizes)
        flat = ids[np.repeat(begin - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)]
        per_piece = np.diff(stop[fill], prepend=0)
        return flat, np.bincount(np.array([i for i, _ in pieces], np.int64), per_piece, len(texts)).astype(np.int64)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Free this process's encoders and the units they remember; the next use loads anew."""
    if _encoders:
        _encoders.clear()
        give_back()


def crc32_u32(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())

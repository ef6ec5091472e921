"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may differ in k = floor(m * (1 - similarity)) word edits.  It is cut
into k + 1 pieces; k edits leave one piece untouched, so every match holds an exact
piece.  Piece hits are found by rolling hashes over word numbers and compared exactly;
around them Myers' bit-parallel algorithm finds the edit distances of the item to all
stretches of words; occurrences that don't overlap are taken, the nearest first.  Words
are lower-cased and stripped of outer punctuation.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, ship, text_bytes, trimmed

SIMILARITY = 0.8
MIN_WORDS = 1  # items of under 5 words have no edit budget: they match exactly
BLOCK_BYTES = 8 << 20
CHUNK = 2 << 20
KEEP = 500_000
BASE = 0x100000001B3
_WORD = re.compile(r"\S+")
_process: dict = {}


def plain(word: str) -> str:
    """Lower case, outer punctuation stripped; what has no letter or digit is empty."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower()


def cut_pieces(m: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 pieces of m words, lengths as even as can be."""
    at = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


class Items:
    """Benchmark items, their vocabulary, and their pieces by length and hash."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, min_words: int = MIN_WORDS):
        self.vocabulary: dict[str, int] = {}
        self.items, self.pieces = [], defaultdict(lambda: defaultdict(list))
        for item_id, text in rows:
            w = [p for p in (plain(x) for x in _WORD.findall(text or "")) if p]
            if len(w) < max(1, min_words):
                continue
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            k = int(len(w) * (1 - similarity) + 1e-9)
            number = len(self.items)
            masks, back = defaultdict(int), defaultdict(int)
            for j, x in enumerate(ids):
                masks[x] |= 1 << j
                back[x] |= 1 << (len(ids) - 1 - j)
            self.items.append((item_id, ids, k, dict(masks), dict(back)))
            for start, n in cut_pieces(len(ids), k):
                piece = np.array(ids[start : start + n], np.uint64)
                self.pieces[n][int(rolling(piece, n)[0])].append((number, start))
        self.hashes = {n: np.array(sorted(h), np.uint64) for n, h in self.pieces.items()}
        self.pieces = {n: dict(h) for n, h in self.pieces.items()}


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + ids[k : len(ids) - n + 1 + k]
    return out ^ (out >> np.uint64(29))


def myers(masks: dict[int, int], m: int, words: list[int], anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of a pattern of m words to a stretch of `words` that ends
    anywhere, and the first such end.  anchored: the stretch starts with words[0]."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(words):
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | (~(horizontal | plus) & full), plus & horizontal
        score += bool(hp & top) - bool(hm & top)
        hp, hm = ((hp << 1) | anchored) & full, (hm << 1) & full
        plus, minus = hm | (~(vertical | hp) & full), hp & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def ends(masks: dict[int, int], m: int, words: list[int], k: int) -> list[tuple[int, int]]:
    """(distance, end) of every end in `words` of a stretch within k edits of the pattern,
    the least distances first."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for j, w in enumerate(words):
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        hp, hm = minus | (~(horizontal | plus) & full), plus & horizontal
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus, minus = hm | (~(vertical | hp) & full), hp & vertical
        if score <= k:
            out.append((score, j + 1))
    return sorted(out)


def occurrences(item: tuple, words: list[int]) -> list[tuple[int, int, int]]:
    """(distance, start, end) of stretches within the item's budget that do not overlap: the
    nearest first, of equals the earlier.  What is left beside one is searched on."""
    _, own, k, masks, back = item
    taken: list[tuple[int, int]] = []
    out = []
    for _, end in ends(masks, len(own), words, k):
        at = bisect(taken, (end - 1, len(words) + 1))
        before = taken[at - 1][1] if at else 0
        if before < end:
            low = max(before, end - len(own) - k)
            distance, size = myers(back, len(own), words[low:end][::-1], True)
            if distance <= k and size:
                insort(taken, (end - size, end))
                out.append((distance, end - size, end))
    return out


def find(items: Items, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item number, distance, first word, end word) of the matches in a word sequence."""
    near = defaultdict(list)
    for n, hashes in items.hashes.items():
        if len(ids) < n:
            continue
        h = rolling(ids.astype(np.uint64), n)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for p in np.flatnonzero(hashes[at] == h).tolist():
            here = ids[p : p + n].tolist()
            for number, start in items.pieces[n][int(h[p])]:
                _, own, k, _, _ = items.items[number]
                if own[start : start + n] == here:
                    near[number].append((max(0, p - start - k), min(len(ids), p - start + len(own) + k)))
    out = []
    for number, spans in near.items():
        spans.sort()
        joined = [list(spans[0])]
        for a, b in spans[1:]:
            if a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        for a, b in joined:
            out += [(number, d, a + s, a + e) for d, s, e in occurrences(items.items[number], ids[a:b].tolist())]
    return out


def _search(batches, shared):
    items = shared.value
    number = items.vocabulary.get
    if _process.get("of") is not items:
        _process.update(of=items, ids={})
    known = _process["ids"]
    fields = ["doc_id", "item_id", "distance", "item_words", "start", "end"]
    for ids, texts in chunks(batches, CHUNK):
        rows = []
        split = [t.decode("utf-8", "replace") for t in texts]
        for doc, text in zip(ids, split):
            w = text.split()
            for x in set(w).difference(known):
                p = plain(x)
                known[x] = number(p, 0) if p else -1
            seq = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
            kept = np.flatnonzero(seq >= 0)
            found = find(items, seq[kept]) if len(kept) else ()
            places = [m.span() for m in _WORD.finditer(text)] if found else []
            for n, distance, first, end in found:
                rows.append((doc, items.items[n][0], distance, len(items.items[n][1]), places[kept[first]][0], places[kept[end - 1]][1]))
        if len(known) > KEEP:
            known.clear()
        cols = list(zip(*rows)) or [[]] * 6
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=fields)


def blocks_of(benchmark: DataFrame, similarity: float, block_bytes: int, min_words: int) -> list:
    """Broadcasts of the items in blocks of about `block_bytes` of text each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes) or 1
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).toLocalIterator()
        out.append(benchmark.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows], similarity, min_words)))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, distance, item_words, start, end) of each match; start and end are
    code points of the text, end exclusive.

    The items are searched in blocks of about `block_bytes`, so what is broadcast is bounded
    however many they are; docs are read once a block.  Null and word-free texts and items
    match nothing, nor do items of under `min_words` words; rows that repeat are matched
    each, and an item that occurs several times in a text gives a row for each occurrence
    that overlaps no other.  An empty table gives no rows.
    """
    ship(docs.sparkSession)
    found = None
    for shared in blocks_of(benchmark, similarity, block_bytes, min_words):
        part = text_bytes(docs).mapInArrow(lambda it, s=shared: _search(it, s), "doc_id long, item_id long, distance long, item_words long, start long, end long")
        found = part if found is None else found.unionAll(part)
    return found


def _clean(batches, shared):
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        rows = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], ["doc_id", "text"])
        hit = {i for out in _search([rows], shared) for i in out.column("doc_id").to_pylist()}
        yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))


def without_matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that match no item of `min_words` words or more, with all their
    columns, in one pass a block.  Null texts match nothing and stay."""
    ship(docs.sparkSession)
    for shared in blocks_of(benchmark, similarity, block_bytes, min_words):
        docs = docs.mapInArrow(lambda it, s=shared: trimmed(_clean(it, s)), docs.schema)
    return docs

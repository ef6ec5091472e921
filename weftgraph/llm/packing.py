"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention stays within a
piece).  Whole sequences are cut from long documents; of the rest, blocks are dealt in
descending order, each piece to the sequence of the lowest cost that has room for it.
A block opens only as many sequences as its tokens fill; where no sequence has room, the
piece is cut at the largest room left.  So a block leaves one sequence unfilled at most.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, first_uid, ship, text_bytes
from .tokens import crc32_u32, encoder, public_path

LENGTH, LINEAR, QUADRATIC = 1024, 1.0, 1.0 / 1024
BLOCK = 4096
CHUNK = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balance(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Deal pieces of `sizes` tokens: (piece, start in it, length, sequence, offset)."""
    n = -(-sum(sizes) // length)
    cheap = [(0.0, s) for s in range(n)]  # sequences by cost
    roomy: list[tuple[int, int]] = []  # sequences set aside as too full, by room
    cost, used, out = [0.0] * n, [0] * n, []

    def put(item, start, size, s):
        out.append((item, start, size, s, used[s]))
        used[s] += size
        cost[s] += linear * size + quadratic * size * size

    todo = [(-size, item, 0) for item, size in enumerate(sizes) if size]
    heapq.heapify(todo)
    while todo:  # sizes never rise, so a sequence set aside returns once at most between uses
        left, item, start = heapq.heappop(todo)
        left = -left
        while roomy and -roomy[0][0] >= left:
            s = heapq.heappop(roomy)[1]
            heapq.heappush(cheap, (cost[s], s))
        while cheap and length - used[cheap[0][1]] < left:
            s = heapq.heappop(cheap)[1]
            if used[s] < length:
                heapq.heappush(roomy, (used[s] - length, s))
        if cheap:
            s = heapq.heappop(cheap)[1]
            put(item, start, left, s)
        else:  # cut at the largest room; the rest waits for its turn by size
            room, s = heapq.heappop(roomy)
            put(item, start, -room, s)
            heapq.heappush(todo, (-(left + room), item, start - room))
        if used[s] < length:
            heapq.heappush(cheap, (cost[s], s))
    return out


def _pack(batches, path: str, end: int, length: int, linear: float, quadratic: float):
    enc = encoder(path)
    sequence = first_uid()
    held: list = []
    rows: list = []

    def deal():
        nonlocal sequence, held
        opened = -1
        for k, start, size, s, offset in balance([len(h[2]) for h in held], length, linear, quadratic):
            doc, before, ids, total = held[k]
            rows.append((doc, before + start, size, crc32_u32(ids[start : start + size]), total, sequence + s, offset))
            opened = max(opened, s)
        sequence += opened + 1
        held = []

    def batch():
        nonlocal rows
        cols = list(zip(*rows)) or [[]] * 7
        rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    for ids, texts in chunks(batches, CHUNK):
        flat, sizes = enc.encode([t.decode("utf-8", "replace") for t in texts], end)
        wide, at = flat.astype("<u4"), 0
        for doc, total in zip(ids, sizes.tolist()):
            whole = total // length * length
            for start in range(0, whole, length):
                rows.append((doc, start, length, crc32_u32(wide[at + start : at + start + length]), total, sequence, 0))
                sequence += 1
            if whole < total:
                held.append((doc, whole, wide[at + whole : at + total].copy(), total))
                if len(held) >= BLOCK:
                    deal()
            at += total
        yield batch()
    if held:
        deal()
        yield batch()


def pack(docs: DataFrame, path: str | None = None, end: int = 0, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Pack every document's ids, followed by `end`, without a shuffle.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null text is empty: it has the end id alone.  Repeated rows are packed each; an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = path or public_path()
    return text_bytes(docs).mapInArrow(lambda it: _pack(it, path, end, length, linear, quadratic), SCHEMA)

"""Token-id files: frequency-ranked ids, byte-aligned variable-length, control bytes apart.

A folder holds `_ranks` (ids by descending frequency, as unsigned 32-bit integers),
`_before` (partitions and the ids before each, as 64-bit integers) and shards.  A shard: magic, counts (documents, ids, bytes of data, the ids before it in its
partition), doc_ids, lengths, control bytes, data bytes.  An id is stored as its rank in
1 to 4 little-endian bytes; one control byte holds the lengths less 1 of four ranks.
Decoding looks the control bytes up in a table of 256 rows and gathers with numpy.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, discard, first_uid, shared_path, ship, small_batches, text_bytes, trimmed
from .files import read_whole, write_whole
from .tokens import crc32_u32, encoder, forget_encoders, public_path

MAGIC, HEAD = b"WTID\x01\x00\x00\x00", struct.Struct("<8sQQQQ")
SHARD_IDS = 2 << 20
BLOCK = 1 << 16  # ids that are packed or unpacked at once, a multiple of four
CHUNK = 2 << 20
RANKS, BEFORE = "_ranks", "_before"
NO_DOC = -(1 << 63)  # stands for a null doc_id in a shard
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    control, data = [], []
    for i in range(0, len(ranks), BLOCK):
        r = ranks[i : i + BLOCK].astype("<u4")
        size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
        codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
        codes[: len(r)] = size - 1
        control.append((codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes())
        data.append(r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks that pack() has coded."""
    codes, raw = np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8)
    out, done = np.empty(n, np.uint32), 0
    for i in range(0, n, BLOCK):
        size = LENGTHS[codes[i // 4 : (i + BLOCK) // 4]].reshape(-1)[: n - i].astype(np.int64)
        ends = np.cumsum(size) + done
        at, done = ends - size, int(ends[-1])
        some = raw[at].astype(np.uint32)
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            some[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
        out[i : i + BLOCK] = some
    return out


def write_shard(doc_ids, lengths, ranks: np.ndarray, before: int) -> bytes:
    control, data = pack(ranks)
    return HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data), before) + np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u8").tobytes() + control + data


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, lengths, ranks, ids before this shard in its partition."""
    magic, docs, n, size, before = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token-id shard")
    at = HEAD.size
    ids, lengths = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    width = -(-n // 4)
    return ids, lengths, unpack(raw[at : at + width], raw[at + width : at + width + size], n), before


def _encode(batches, path: str, end: int):
    """Rows (doc_id, ids, null); at the end of a partition one (null, null, seen) with how
    often it has each id."""
    enc = encoder(path)
    total = np.zeros(max(enc.size, end + 1), np.int64)
    for docs, texts in chunks(batches, CHUNK):
        ids, sizes = enc.encode([t.decode("utf-8", "replace") for t in texts], end)
        total += np.bincount(ids, minlength=len(total))
        offsets = np.r_[0, np.cumsum(sizes)] * enc.dtype.itemsize
        coded = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
        yield pa.record_batch({"doc_id": pa.array(docs, pa.int64()), "ids": coded, "seen": pa.nulls(len(docs), pa.binary())})
    at = np.flatnonzero(total)
    if len(at):
        yield pa.record_batch({"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "seen": pa.array([np.stack([at, total[at]]).astype("<i8").tobytes()], pa.binary())})


def _tally(batches):
    for batch in batches:
        for raw in batch.column("seen").to_pylist():
            at, n = np.frombuffer(raw, "<i8").reshape(2, -1)
            yield pa.record_batch({"id": pa.array(at), "n": pa.array(n)})


def _write(batches, folder: str, width: int):
    forget_encoders()  # those of the tasks before; nothing is encoded from here on
    dtype, part = np.dtype(f"<u{width}"), first_uid() >> 33
    id_of = np.frombuffer(read_whole(folder, RANKS), "<u4")
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    held: list = []
    size = before = seq = 0

    def flush():
        nonlocal held, size, before, seq
        ranks = rank_of[np.concatenate([x for _, _, x in held])]
        docs, lengths = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        write_whole(folder, f"part-{part:06d}-{seq:06d}", write_shard(docs, lengths, ranks, before))
        before, seq, held, size = before + len(ranks), seq + 1, [], 0

    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        coded = batch.column("ids")
        at = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1].astype(np.int64) // width
        ids = np.frombuffer(coded.buffers()[2], dtype, int(at[-1] - at[0]), int(at[0]) * width)
        if held and size + len(ids) > SHARD_IDS:
            flush()
        held.append((batch.column("doc_id").fill_null(NO_DOC).to_numpy(), np.diff(at), ids.copy()))
        size += len(ids)
    if held:
        flush()
    yield pa.record_batch({"part": pa.array([part] if seq else [], pa.int32()), "n": pa.array([before] if seq else [], pa.int64())})


def _read(batches, folder: str):
    forget_encoders()
    id_of = before_part = None
    for batch in batches:
        for name in (path.rpartition("/")[2] for path in batch.column("path").to_pylist()):
            if id_of is None:
                id_of = np.frombuffer(read_whole(folder, RANKS), "<u4")
                before_part = dict(np.frombuffer(read_whole(folder, BEFORE), "<i8").reshape(-1, 2).tolist())
            docs, lengths, ranks, before = read_shard(read_whole(folder, name))
            ids, ends = id_of[ranks], np.cumsum(lengths)
            yield pa.record_batch({
                "doc_id": pa.array(docs, mask=docs == NO_DOC), "start": pa.array(ends - lengths + before + before_part[int(name[5:11])]), "n_tokens": pa.array(lengths),
                "ids_crc32": pa.array([crc32_u32(ids[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())], pa.int64()),
            })


def write(docs: DataFrame, path: str | None = None, end: int = 2) -> str:
    """Write all documents' ids, each document's followed by `end`, in ascending doc_id
    order; the folder, from which alone read() decodes.  What the driver holds is bounded
    by the vocabulary and by the number of shuffle partitions."""
    spark, path = docs.sparkSession, path or public_path()
    ship(spark)
    small_batches(spark)
    folder = shared_path(spark, "token-ids")
    width = encoder(path).dtype.itemsize
    coded = cut(text_bytes(docs).mapInArrow(lambda it: trimmed(_encode(it, path, end)), "doc_id long, ids binary, seen binary"), "token-cut", "zstd")
    totals = coded.where("seen is not null").select("seen").mapInArrow(_tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = totals["id"].to_numpy(), totals["n"].to_numpy()
    write_whole(folder, RANKS, ids[np.lexsort((ids, -n))].astype("<u4").tobytes())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = coded.where("seen is null").select("doc_id", "ids")
    written = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").mapInArrow(lambda it: trimmed(_write(it, folder, width)), "part int, n long")
    sizes = sorted((r["part"], r["n"]) for r in written.collect())
    discard(coded)
    before = np.cumsum([0, *(n for _, n in sizes)])[:-1]
    write_whole(folder, BEFORE, np.array([(p, b) for (p, _), b in zip(sizes, before)], "<i8").tobytes())
    return folder


def read(spark, folder: str) -> DataFrame:
    """One row per document: doc_id, start (all ids before it), n_tokens, ids_crc32.  Spark
    lists the shards and deals them out by size; the workers read them, one at a time."""
    ship(spark)
    small_batches(spark)
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path").mapInArrow(lambda it: trimmed(_read(it, folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str | None = None, end: int = 2) -> DataFrame:
    """write(), then read().  A null text is empty: it has the end id alone.  Rows of one
    doc_id follow each other, null doc_ids come first; an empty table gives no rows."""
    return read(docs.sparkSession, write(docs, path, end))

"""Shared helpers: text conventions, batches, counts."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, discard, shared_path, shared_root, ship  # noqa: F401

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 2 << 20  # of the batches in which rows go to a Python worker; see small_batches()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a string column (null: null)."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def first_uid() -> int:
    """The first of 2**33 row ids that belong to this task's partition."""
    ctx = TaskContext.get()
    return (ctx.partitionId() if ctx else 0) << 33


def small_batches(spark: SparkSession) -> None:
    """Unless the session has a limit of its own, its Arrow batches have BATCH_BYTES from now
    on.  By rows alone 10,000 whole texts are a batch, often all that a task reads; its
    buffers grow by doubling outside the JVM's heap, and once more in the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def trimmed(rows):
    """The same rows; after the last, what was freed goes back to the system.  An idle worker
    would keep it for a minute beside what the JVM runs next."""
    try:
        yield from rows
    finally:
        give_back()


def chunks(batches, byte_limit: int):
    """Split Arrow batches with columns doc_id, text into (ids, utf-8 texts) lists of
    at most byte_limit bytes (or one text); a null text counts as empty."""
    ids, texts, size = [], [], 0
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            t = b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
            if ids and size + len(t) > byte_limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


def text_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text as UTF-8 bytes, the input of the Arrow operators."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def merge_counts(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)

"""Checksums: CRC-32 built in, CRC-32C by a pandas UDF, whole and running."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1).astype(np.uint32)
    return c


FEW = 16  # fewer long values are faster one by one
STEPS = _table()
TABLE = [int(x) for x in STEPS]


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C (Castagnoli) of bytes, continuing from crc."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = TABLE[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def crc32c_all(values: list) -> list:
    """crc32c of every value (null: null): one byte of all values at a time, the values
    sorted by length, so that each step takes those that go on."""
    there = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: -len(values[i]))
    size = np.array([len(values[i]) for i in there], np.int64)
    data = np.frombuffer(b"".join(bytes(values[i]) for i in there), np.uint8)
    start = np.cumsum(size) - size
    crc = np.full(len(there), 0xFFFFFFFF, np.uint32)
    left, at = len(there), 0
    while left:
        left = int(np.searchsorted(-size[:left], -at, "left"))
        if left < FEW:
            break
        crc[:left] = STEPS[(crc[:left] ^ data[start[:left] + at]) & 0xFF] ^ (crc[:left] >> 8)
        at += 1
    out: list = [None] * len(values)
    for k, (i, c) in enumerate(zip(there, (crc ^ np.uint32(0xFFFFFFFF)).tolist())):
        out[i] = crc32c(bytes(values[i])[at:], c) if k < left else c
    return out


@F.pandas_udf(T.LongType())
def crc32c_udf(s: pd.Series) -> pd.Series:
    return pd.Series(crc32c_all(list(s)), s.index, "Int64")


def crc_text(c: Column) -> Column:
    """CRC-32 of bytes as decimal text."""
    return F.crc32(c).cast("string")


def running_crc(chunks: DataFrame, by: str, seq: str, chunk: str) -> DataFrame:
    """(by, crc): CRC-32 over a stream's chunks in order, emitted at its end.

    A stream's chunks meet in one task in order, as a running checksum must see them.
    """
    import zlib

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        crc = 0
        for b in pdf.sort_values(seq)[chunk]:
            crc = zlib.crc32(bytes(b), crc)
        return pd.DataFrame({by: [key[0]], "crc": [crc]})

    kind = dict(chunks.dtypes)[by]
    return chunks.select(by, seq, F.col(chunk).cast("binary").alias(chunk)).groupBy(by).applyInPandas(fold, f"{by} {kind}, crc long")

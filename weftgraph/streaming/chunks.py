"""Streams of chunks (uid, seq, chunk, last): a running CRC, status, fan-out to consumers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CRC_SCHEMA = "uid string, n_chunks long, crc long"


class RunningCrc(StatefulProcessor):
    """State of a stream: next sequence number, CRC so far, and chunks that came early.
    A row is emitted once the last chunk, and all before it, have been seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "next long, crc long, last long")
        self.early = handle.getMapState("early", "seq long", "chunk binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nxt, crc, last = self.at.get() if self.at.exists() else (0, 0, -1)
        for pdf in rows:
            for seq, chunk, end in zip(pdf["seq"], pdf["chunk"], pdf["last"]):
                if seq >= nxt:
                    self.early.updateValue((int(seq),), (bytes(chunk),))
                if end:
                    last = int(seq)
        while self.early.containsKey((nxt,)):
            crc = zlib.crc32(self.early.getValue((nxt,))[0], crc)
            self.early.removeKey((nxt,))
            nxt += 1
        self.at.update((nxt, crc, last))
        if 0 <= last < nxt:
            self.at.clear()
            yield pd.DataFrame({"uid": [key[0]], "n_chunks": [nxt], "crc": [crc]})

    def close(self) -> None:
        pass


def running_crc(stream: DataFrame) -> DataFrame:
    """(uid, n_chunks, crc) of every stream that has completed."""
    return stream.select("uid", "seq", F.col("chunk").cast("binary").alias("chunk"), "last").groupBy("uid").transformWithStateInPandas(RunningCrc(), CRC_SCHEMA, "append", "none")


def latest_status(events: DataFrame) -> DataFrame:
    """Running last status of each uid; ts breaks into the newest, event_id breaks ties."""
    return events.groupBy("uid").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def fan_out(stream: DataFrame, consumers: dict[str, Callable[[DataFrame], None]], checkpoint: str, name: str = "fan_out"):
    """Every batch of chunks to every consumer, in the order given, before the next batch."""

    def deliver(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for consume in consumers.values():
            consume(batch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).queryName(name).start()


def piped(df: DataFrame, command: str, column: str = "value"):
    """Lines of a command that reads the column from its standard input, one process for
    each partition."""
    return df.select(F.col(column).cast("string")).rdd.map(lambda r: r[0] or "").pipe(command)

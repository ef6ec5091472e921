"""Stores as DataFrame readers and writers."""

from __future__ import annotations

import json
import os
import pickle
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The parts of an upload, and of a copy, in bytes.
UPLOAD_PART, COPY_BUFFER = 5 << 20, 64 << 10
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc", ".txt": "text"}


class StoreError(NotImplementedError):
    """An operation that a store does not offer."""


def null_source(spark: SparkSession, schema: str = "value binary") -> DataFrame:
    """Reads nothing."""
    return spark.createDataFrame([], schema)


def null_sink(df: DataFrame) -> None:
    """Runs the plan and writes nothing."""
    df.write.format("noop").mode("overwrite").save()


def memory(spark: SparkSession, rows, schema: str | None = None) -> DataFrame:
    """An in-memory payload: cached, dropped after use unless kept."""
    return spark.createDataFrame(rows, schema).cache()


def shared_memory(df: DataFrame) -> DataFrame:
    """A payload kept in the executors' memory alone."""
    return df.persist(StorageLevel.MEMORY_ONLY)


def read_file(spark: SparkSession, path: str, check: bool = True, schema: str | None = None, **options) -> DataFrame:
    """A file or folder by its suffix; anything else as bytes.  check: a missing path fails
    now, not when it is read."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1], "binaryFile")
    reader = spark.read.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    if check:
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
            raise FileNotFoundError(path)
    return reader.load(path)


def write_file(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", **options) -> str:
    """Write a table; an empty one leaves an empty table there."""
    df.write.format(kind).mode(mode).options(**options).save(path)
    return path


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file of a tree."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def directory_size(spark: SparkSession, path: str) -> int:
    return directory(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A relational table; filters and column lists are pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def s3(spark: SparkSession, bucket: str, key: str, **options) -> DataFrame:
    """An object by its s3a address; the connector must be on the class path."""
    return read_file(spark, f"s3a://{bucket}/{key}", check=False, **options)


def parset(arguments: dict, mode: str = "yaml") -> bytes:
    """Arguments as ini, json, toml, yaml, yanda (k=v lines) or pickle; an unknown mode is
    yaml."""
    if mode == "json":
        return json.dumps(arguments, indent=2, default=str).encode()
    if mode == "pickle":
        return pickle.dumps(arguments)
    if mode == "yanda":
        return "\n".join(f"{k}={v}" for k, v in arguments.items()).encode()
    if mode == "ini":
        return ("[DEFAULT]\n" + "\n".join(f"{k} = {v}" for k, v in arguments.items()) + "\n").encode()
    if mode == "toml":
        return "\n".join(f"{k} = {json.dumps(v) if not isinstance(v, bool) else str(v).lower()}" for k, v in arguments.items()).encode()
    return "\n".join(f"{k}: {json.dumps(v) if isinstance(v, (str, list, dict)) else v}" for k, v in arguments.items()).encode()


def chunks_of(df: DataFrame, by: str, seq: str, chunk: str) -> DataFrame:
    """(by, content): the chunks of each drop joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.hex(chunk).alias("hex"))))
    return df.groupBy(by).agg(F.unhex(F.array_join(F.transform(pairs, lambda x: x["hex"]), "")).alias("content"))


def copy(df: DataFrame, *paths: str, kind: str = "parquet") -> None:
    """One input to every output; directories go to directories alone."""
    for p in paths:
        if Path(p).is_file():
            raise StoreError(f"{p} is a file")
        write_file(df, p, kind)


def compressed(df: DataFrame, path: str, codec: str = "gzip") -> str:
    """Write rows as a compressed stream of JSON lines."""
    df.write.mode("overwrite").option("compression", codec).json(path)
    return path


def json_list(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, to be streamed as a list."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def listen(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines that a TCP client sends."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def fetch(spark: SparkSession, urls: DataFrame, column: str = "url", timeout: int = 30) -> DataFrame:
    """(url, content) of addresses, fetched by the tasks; what cannot be had is null."""
    import pyarrow as pa

    def get(batches):
        from urllib.request import urlopen

        for b in batches:
            names, out = b.column(0).to_pylist(), []
            for u in names:
                try:
                    with urlopen(u, timeout=timeout) as r:  # noqa: S310
                        out.append(r.read())
                except (OSError, ValueError):
                    out.append(None)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["url", "content"])

    return urls.select(F.col(column).cast("string").alias("url")).mapInArrow(get, "url string, content binary")


def open_source(spark: SparkSession, url: str):
    """A reader by scheme: file, null, s3a, http(s), ngas (an archive over HTTP); None for
    any other."""
    scheme, _, rest = url.partition("://")
    if scheme == "file":
        return read_file(spark, url)
    if scheme == "null":
        return null_source(spark)
    if scheme in ("s3", "s3a"):
        bucket, _, key = rest.partition("/")
        return s3(spark, bucket, key)
    if scheme in ("http", "https"):
        return fetch(spark, spark.createDataFrame([(url,)], "url string"))
    if scheme == "ngas":
        host, _, file_id = rest.partition("/")
        return fetch(spark, spark.createDataFrame([(f"http://{host}/RETRIEVE?file_id={file_id}",)], "url string"))
    return None


def sink(df: DataFrame, url: str) -> None:
    """Archive a table at an address."""
    scheme = url.partition("://")[0]
    if scheme == "null":
        null_sink(df)
    elif scheme in ("file", "s3a", "hdfs"):
        write_file(df, url)
    else:
        raise StoreError(f"no sink for {scheme}")

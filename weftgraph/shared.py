"""Storage that all machines share, and shipping this package's code to the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_root: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Workers on other machines need not have the package installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(os.path.realpath(tempfile.mkdtemp()), "weftgraph_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir.  Where that is unset, one below
    the warehouse, or in a single process, as in tests, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _own_root:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        _own_root[app] = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="weftgraph-")) if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return _own_root[app]


def _hadoop(spark: SparkSession, path: str):
    """The store of a path and the path in it, as the JVM sees them."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the
    application ends."""
    path = f"{shared_root(spark)}/weftgraph/{kind}-{uuid.uuid4().hex}"
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame, kind: str = "cut", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that
    outlive any executor, and later scans prune columns."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    writer = df.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table that cut() has written; nothing may read it any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        fs, p = _hadoop(df.sparkSession, path)
        fs.delete(p, True)

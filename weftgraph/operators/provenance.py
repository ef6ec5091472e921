"""Provenance: field selection, Merkle hashes, block hashes, signatures, comparison.

Digests are SHA3-256 in hexadecimal (a pandas UDF, as there is no built-in).  A Merkle root
pairs hashes level by level, an odd one moving up alone; it is our own layout: equal inputs
give equal roots and the order of parents does not matter, other libraries' digests differ.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ReproMode
from ..shared import cut, ship


def sha3(data: bytes | str) -> str:
    return hashlib.sha3_256(data.encode() if isinstance(data, str) else data).hexdigest()


def merkle_root(hashes: list[str]) -> str:
    """Root over hex digests; the hash of nothing is that of empty bytes."""
    level = list(hashes)
    if not level:
        return sha3(b"")
    while len(level) > 1:
        level = [sha3("\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def merkle_of(values: list) -> str:
    return merkle_root([sha3("\x00" + str(v)) for v in values])


@F.pandas_udf(T.StringType())
def sha3_hex(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else sha3(v))


@F.pandas_udf(T.StringType())
def merkle_hex(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else merkle_of(list(v)))


def select_fields(params: Column, store: list[str] = (), count: list[str] = (), first_removed: list[str] = ()) -> Column:
    """Of a map's entries: those stored, the sizes of those counted (comma lists), those
    whose first element is removed; absent names are left out."""
    kept = F.map_filter(params, lambda k, v: k.isin(list(store))) if store else F.expr("cast(map() as map<string,string>)")
    counted = F.transform_values(F.map_filter(params, lambda k, v: k.isin(list(count))), lambda k, v: F.size(F.split(v, ",")).cast("string")) if count else None
    cutoff = F.transform_values(F.map_filter(params, lambda k, v: k.isin(list(first_removed))), lambda k, v: F.regexp_replace(v, "^[^,]*,?", "")) if first_removed else None
    for more in (counted, cutoff):
        if more is not None:
            kept = F.map_concat(kept, more)
    return kept


def own_hash(params: Column) -> Column:
    """Digest of a map, whatever the order of its entries."""
    return merkle_hex(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))


def runtime_fields(rmode: int) -> list[str]:
    """What a finished drop commits under a mode."""
    return {
        ReproMode.RERUN: ["status"], ReproMode.REPEAT: ["status"], ReproMode.RECOMPUTE: ["status", "stdout", "args"], ReproMode.REPRODUCE: ["data_hash"],
        ReproMode.REPLICATE_SCI: ["status", "data_hash"], ReproMode.REPLICATE_COMP: ["status", "stdout", "args", "data_hash"], ReproMode.REPLICATE_TOTAL: ["status", "data_hash"],
    }.get(rmode, [])


def block_hashes(nodes: DataFrame, edges: DataFrame, reproduce: bool = False) -> DataFrame:
    """(oid, block): Merkle root of a node's own hash and the sorted blocks of its parents,
    level by level.  reproduce: only data nodes at the ends (no parents or no children)
    hash; others pass their parents' blocks on.  A cycle is a ValueError.

    nodes(oid, own, kind); what a level needs is one join and one grouping.
    """
    ship(nodes.sparkSession)
    if reproduce:
        ends = nodes.join(edges.select(F.col("dst").alias("oid")), "oid", "left_anti").select("oid").union(nodes.join(edges.select(F.col("src").alias("oid")), "oid", "left_anti").select("oid")).distinct().withColumn("end", F.lit(True))
        nodes = nodes.join(ends, "oid", "left").withColumn("hashes", F.coalesce("end", F.lit(False)) & (F.col("kind") == "data"))
    else:
        nodes = nodes.withColumn("hashes", F.lit(True))
    todo = cut(nodes.select("oid", "own", "hashes"), "blocks")
    links = edges.select("src", "dst").distinct()
    done = None
    while not todo.isEmpty():
        ready = todo.join(links.join(todo.select(F.col("oid").alias("src")), "src").select(F.col("dst").alias("oid")), "oid", "left_anti")
        if done is None:
            fed = ready.withColumn("parents", F.expr("cast(array() as array<string>)"))
        else:
            up = links.join(done.select(F.col("oid").alias("src"), "out"), "src").groupBy(F.col("dst").alias("oid")).agg(F.flatten(F.collect_list("out")).alias("parents"))
            fed = ready.join(up, "oid", "left").withColumn("parents", F.coalesce("parents", F.expr("cast(array() as array<string>)")))
        fed = fed.withColumn("block", F.when(F.col("hashes"), merkle_hex(F.concat(F.array("own"), F.sort_array(F.array_distinct("parents"))))))
        fed = cut(fed.select("oid", "block", F.when(F.col("hashes"), F.array("block")).otherwise(F.sort_array(F.array_distinct("parents"))).alias("out")), "blocks")
        if fed.isEmpty():
            raise ValueError("not a DAG")
        done = fed if done is None else done.unionByName(fed)
        todo = cut(todo.join(fed.select("oid"), "oid", "left_anti"), "blocks")
    if done is None:
        return nodes.select("oid", F.lit(None).cast("string").alias("block")).limit(0)
    return done.select("oid", F.coalesce("block", merkle_hex("out")).alias("block"))


def signature(blocks: DataFrame, edges: DataFrame) -> str:
    """Merkle root of the sorted blocks of a graph's leaves.  The sorting is distributed and
    the root is folded over the sorted stream, so no list of all leaves is held."""
    ends = blocks.join(edges.select(F.col("src").alias("oid")), "oid", "left_anti").select("block").orderBy("block")
    stack: list[tuple[int, str]] = []  # (height, hash), as in a binary counter
    for row in ends.toLocalIterator():
        h, v = 0, sha3("\x00" + row["block"])
        while stack and stack[-1][0] == h:
            v = sha3("\x01" + stack.pop()[1] + v)
            h += 1
        stack.append((h, v))
    if not stack:
        return sha3(b"")
    v = stack.pop()[1]
    while stack:
        v = sha3("\x01" + stack.pop()[1] + v)
    return v


def compare(signatures: DataFrame, run: str = "run") -> DataFrame:
    """(a, b, mode, equal) of all unordered pairs of runs; two missing ones are equal.

    signatures(run, mode, signature) has a row for each run and mode, so pairs are formed
    within a mode; their number is the answer's.
    """
    a = signatures.select(F.col(run).alias("a"), "mode", F.col("signature").alias("sa"))
    b = signatures.select(F.col(run).alias("b"), "mode", F.col("signature").alias("sb"))
    return a.join(b, "mode").where("a < b").select("a", "b", "mode", F.col("sa").eqNullSafe(F.col("sb")).alias("equal"))


def report(comparison: DataFrame, path: str) -> None:
    comparison.write.mode("overwrite").option("header", True).csv(path)

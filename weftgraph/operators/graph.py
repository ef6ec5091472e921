"""Graph analytics over nodes(oid, ...) and edges(src, dst, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut

COMPACT = 16  # levels after which the tables of a fixpoint become one
APP_TO_DATA = 5  # weight of an edge whose data node gives none


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("oid")), "oid", "left_anti")


def leaves(nodes: DataFrame, edges: DataFrame, service: str | None = None) -> DataFrame:
    """Nodes without successors; services never are leaves."""
    found = nodes.join(edges.select(F.col("src").alias("oid")), "oid", "left_anti")
    return found.where(F.coalesce(F.col("category") != service, F.lit(True))) if service else found


def neighbours(edges: DataFrame, direction: str = "down") -> DataFrame:
    """(oid, neighbour) pairs, up: producers and inputs, down: consumers and outputs."""
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    return edges.select(F.col(a).alias("oid"), F.col(b).alias("neighbour")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(oid, n_in, n_out) of every node; counted before the join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("oid"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("oid"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    counts = ends.groupBy("x.oid").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))
    return nodes.select("oid").join(counts, "oid", "left").select("oid", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def bfs(edges: DataFrame, starts: DataFrame, prune=None, depth: int = 10_000) -> DataFrame:
    """(oid, depth): least number of edges from any start.  prune, a condition on src, dst
    and depth, keeps an edge from being followed.  Each level is one join against what is
    not yet seen.  A graph of more than `depth` levels is a ValueError."""
    seen = cut(starts.select("oid").distinct().withColumn("depth", F.lit(0)), "bfs")
    last, parts = seen, 0
    for d in range(1, depth + 1):
        step = edges.join(last.select(F.col("oid").alias("src"), "depth"), "src")
        if prune is not None:
            step = step.where(~prune)
        fresh = step.select(F.col("dst").alias("oid")).distinct().join(seen.select("oid"), "oid", "left_anti").withColumn("depth", F.lit(d))
        last = cut(fresh, "bfs")
        if last.isEmpty():
            return seen
        seen, parts = seen.unionByName(last), parts + 1
        if parts % COMPACT == 0:  # one table again, so that plans stay small
            seen = cut(seen, "bfs")
    raise ValueError(f"deeper than {depth} levels")


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, int]:
    """(oid, level) by Kahn's algorithm, and how many nodes lie on or behind a cycle."""
    left, out, n = cut(edges.select("src", "dst").distinct(), "kahn"), None, 0
    todo = cut(nodes.select("oid").distinct(), "kahn")
    while not todo.isEmpty():
        free = cut(todo.join(left.select(F.col("dst").alias("oid")), "oid", "left_anti"), "kahn")
        if free.isEmpty():
            break
        done = free.withColumn("level", F.lit(n))
        out = done if out is None else out.unionByName(done)
        if (n + 1) % COMPACT == 0:
            out = cut(out, "kahn")
        todo = cut(todo.join(free, "oid", "left_anti"), "kahn")
        left = cut(left.join(free.select(F.col("oid").alias("src")), "src", "left_anti"), "kahn")
        n += 1
    if out is None:
        out = nodes.select("oid").withColumn("level", F.lit(0)).limit(0)
    return out, todo.count()


def dag_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, weight) with the data end's weight; nodes(oid, kind, weight)."""
    kind = nodes.select("oid", "kind", F.col("weight").alias("w"))
    both = edges.join(kind.select(F.col("oid").alias("src"), F.col("kind").alias("sk"), F.col("w").alias("sw")), "src").join(kind.select(F.col("oid").alias("dst"), F.col("kind").alias("dk"), F.col("w").alias("dw")), "dst")
    return both.select("src", "dst", F.when(F.col("sk") == "data", F.col("sw")).when(F.col("dk") == "data", F.coalesce("dw", F.lit(APP_TO_DATA))).otherwise(F.lit(APP_TO_DATA)).alias("weight"))


def _relax(nodes: DataFrame, edges: DataFrame, own: bool, rounds: int = 10_000) -> DataFrame:
    """Greatest start value of every node: 0 at roots, else the maximum over producers of
    theirs plus their own weight plus the edge's.  Only nodes whose value grew are joined
    again, so a level of the graph is one small round."""
    front = cut(nodes.select("oid", "weight", F.lit(0).cast("long").alias("stt")), "relax")
    grown = [front]
    for _ in range(rounds):
        push = edges.join(front.select(F.col("oid").alias("src"), F.col("stt"), F.col("weight").alias("nw")), "src").groupBy(F.col("dst").alias("oid")).agg(F.max(F.col("stt") + F.col("weight") + (F.col("nw") if own else F.lit(0))).alias("new"))
        value = reduce(DataFrame.unionAll, grown).groupBy("oid").agg(F.max("weight").alias("weight"), F.max("stt").alias("stt"))
        front = cut(value.join(push, "oid").where(F.col("new") > F.col("stt")).select("oid", "weight", F.col("new").alias("stt")), "relax")
        if front.isEmpty():
            return value
        grown.append(front)
        if len(grown) > 16:
            grown = [cut(reduce(DataFrame.unionAll, grown).groupBy("oid").agg(F.max("weight").alias("weight"), F.max("stt").alias("stt")), "relax")]
    raise ValueError("not a DAG")


def label_schedule(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(oid, stt, edt): earliest start and end; nodes(oid, weight), edges(src, dst, weight)."""
    return _relax(nodes, edges, True).select("oid", "stt", (F.col("stt") + F.col("weight")).alias("edt"))


def longest_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(oid, length): weight of the heaviest path that ends with each node."""
    return label_schedule(nodes, edges).select("oid", F.col("edt").alias("length"))


def longest_path_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[list[str], int]:
    """The heaviest path and its length: only the nodes of the path come to the driver."""
    lengths = cut(longest_path(nodes, edges), "longest")
    w = nodes.select("oid", "weight")
    best = lengths.orderBy(F.desc("length"), "oid").first()
    if best is None:
        return [], 0
    back = edges.join(lengths.select(F.col("oid").alias("src"), "length"), "src").join(w.select(F.col("oid").alias("dst"), F.col("weight").alias("dw")), "dst")
    back = cut(back.groupBy("dst").agg(F.max(F.struct((F.col("length") + F.col("weight") + F.col("dw")).alias("total"), "src")).alias("m")).select("dst", "m.src"), "longest")
    path = [best["oid"]]
    while (step := back.where(F.col("dst") == path[-1]).first()) is not None:
        path.append(step["src"])
    return path[::-1], best["length"]


def gantt(schedule: DataFrame) -> DataFrame:
    """(oid, t) for every time at which a node runs."""
    return schedule.where("edt > stt").select("oid", F.explode(F.sequence(F.col("stt"), F.col("edt") - 1)).alias("t"))


def workload(schedule: DataFrame) -> DataFrame:
    """One row: mean busy lanes, the most at once, and their ratio in percent, rounded down."""
    busy = gantt(schedule).groupBy("t").agg(F.count("*").alias("busy"))
    mean = F.floor(F.avg("busy"))
    return busy.agg(mean.cast("long").alias("workload"), F.max("busy").alias("max_dop"), F.floor(100 * mean / F.max("busy")).cast("long").alias("efficiency"))


def data_movement(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Weight of the edges between partitions; parts(oid, part)."""
    both = edges.join(parts.select(F.col("oid").alias("src"), F.col("part").alias("p")), "src").join(parts.select(F.col("oid").alias("dst"), F.col("part").alias("q")), "dst")
    return both.agg(F.coalesce(F.sum(F.when(F.col("p") != F.col("q"), F.col("weight")).otherwise(0)), F.lit(0)).alias("movement"))


def unmet_relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which one end is missing."""
    ids = nodes.select("oid").distinct()
    no_dst = edges.join(ids.withColumnRenamed("oid", "dst"), "dst", "left_anti").select("src", "dst")
    no_src = edges.join(ids.withColumnRenamed("oid", "src"), "src", "left_anti").select("src", "dst")
    return no_dst.union(no_src).distinct()


def relations_by_node_pair(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host_a, host_b, n): relations across hosts, in both directions; hosts(oid, host)."""
    both = edges.join(hosts.select(F.col("oid").alias("src"), F.col("host").alias("a")), "src").join(hosts.select(F.col("oid").alias("dst"), F.col("host").alias("b")), "dst").where("a <> b")
    one = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    return one.unionAll(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy(F.col("a").alias("host_a"), F.col("b").alias("host_b")).agg(F.sum("n").alias("n"))


def group_by_host(nodes: DataFrame, host: str = "node") -> DataFrame:
    """(host, n_uids): drops of each host."""
    return nodes.groupBy(host).agg(F.count("*").alias("n_uids"))

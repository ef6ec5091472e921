"""Logical graphs to physical graphs: constructs become joins and arithmetic on instance ids.

A logical graph is small and is analysed on the driver; its expansion is not: one row for
each instance comes from exploding an index over the product of the enclosing degrees of
parallelism, and edges come from arithmetic on both ends' flat indexes.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = {
    "Scatter": ("num_of_copies", "num_of_splits", "Number of copies"),
    "Gather": ("gather_width", "num_of_inputs", "Gather width"),
    "Loop": ("num_of_iter", "Number of Iterations", "Number of loops"),
    "MPI": ("num_of_procs",),
}
DEFAULT_COPIES = 4
NESTING = ("Scatter", "Loop", "GroupBy")
DROPPED = ("Comment", "Description")


@dataclass
class Node:
    id: str
    name: str
    category: str
    parent: str | None = None
    kind: str = "app"
    fields: dict = field(default_factory=dict)
    start: bool = False
    end: bool = False

    @property
    def group(self) -> bool:
        return self.category in ("Scatter", "Gather", "GroupBy", "Loop", "MKN")


@dataclass
class Link:
    src: str
    dst: str
    port: str = ""
    loop_aware: bool = False


class GraphError(ValueError):
    pass


def truthy(v) -> bool:
    """The words that mean true."""
    return v is True or str(v) in ("1", "true", "True", "yes")


def load(source) -> dict:
    """A logical graph from a path, an open file or a dictionary."""
    if isinstance(source, dict):
        return source
    if hasattr(source, "read"):
        return json.load(source)
    with open(source) as f:
        return json.load(f)


class LogicalGraph:
    """Nodes, links and the degrees of parallelism they imply."""

    def __init__(self, nodes: list[Node], links: list[Link]):
        kept = [n for n in nodes if n.category not in DROPPED]
        self.nodes = {n.id: n for n in kept}
        self.links = [x for x in links if x.src in self.nodes and x.dst in self.nodes]
        self.links = without_services(self)
        self._dop: dict[str, int] = {}
        self.validate()

    @classmethod
    def from_json(cls, source) -> LogicalGraph:
        raw = load(source)
        nodes = []
        for x in raw.get("nodeDataArray", []):
            values = {f.get("name", f.get("id")): f.get("value") if f.get("value") not in (None, "") else f.get("defaultValue") for f in x.get("fields", [])}
            kind = "data" if str(x.get("categoryType", "")).lower() == "data" else "app"
            nodes.append(Node(str(x["id"]), x.get("name", ""), x.get("category", ""), x.get("parentId") or None, kind, values, truthy(values.get("group_start")), truthy(values.get("group_end"))))
        links = [Link(str(x["from"]), str(x["to"]), x.get("fromPort", ""), truthy(x.get("loop_aware"))) for x in raw.get("linkDataArray", [])]
        return cls(nodes, links)

    def groups(self, node: Node) -> list[Node]:
        """Enclosing groups, outermost first."""
        out, at = [], node.parent
        while at is not None:
            if at not in self.nodes:
                raise GraphError(f"{node.id}: no group {at}")
            out.append(self.nodes[at])
            at = self.nodes[at].parent
            if len(out) > len(self.nodes):
                raise GraphError(f"{node.id}: groups nest in a circle")
        return out[::-1]

    def h_level(self, node: Node) -> int:
        return len(self.groups(node)) + (node.category == "MPI")

    def hierarchy(self, node: Node) -> str:
        return "-".join(["0", *(g.id for g in self.groups(node))])

    def _number(self, node: Node, default: int | None) -> int:
        for name in ALIASES.get(node.category, ()):
            if node.fields.get(name) not in (None, ""):
                n = int(node.fields[name])
                if n < 1:
                    raise GraphError(f"{node.id}: {name} is {n}")
                return n
        if default is None:
            raise GraphError(f"{node.id}: no {ALIASES[node.category][0]}")
        return default

    def feeding(self, group: Node) -> list[Node]:
        """Nodes outside a group that link into it."""
        inside = {n.id for n in self.nodes.values() if group in self.groups(n)}
        return [self.nodes[x.src] for x in self.links if x.dst in inside and x.src not in inside]

    def dop(self, group: Node) -> int:
        """Instances of a group within one instance of its parent."""
        if group.id in self._dop:
            return self._dop[group.id]
        if group.category == "Scatter":
            n = self._number(group, DEFAULT_COPIES)
        elif group.category == "Loop":
            n = self._number(group, None)
        elif group.category == "Gather":
            sources = self.feeding(group)
            total = max((self.relative(s, group) for s in sources), default=1)
            n = math.ceil(total / self._number(group, 1))
        elif group.category == "GroupBy":
            n = math.prod(self.dop(self.nodes[g]) for g in self.keys(group))
        else:
            raise GraphError(f"{group.id}: unrecognised group {group.category}")
        self._dop[group.id] = n
        return n

    def keys(self, group: Node) -> list[str]:
        """The scatters whose index is kept by a GroupBy: its group_key, else the innermost
        scatter of its input."""
        named = group.fields.get("group_key")
        if named not in (None, "", "None"):
            return [k.strip() for k in str(named).split(",")]
        sources = self.feeding(group)
        scatters = [g for s in sources[:1] for g in self.groups(s) if g.category == "Scatter"]
        if not scatters:
            raise GraphError(f"{group.id}: GroupBy without a scatter before it")
        return [scatters[-1].id]

    def relative(self, node: Node, group: Node) -> int:
        """How many instances of node there are for one instance of group's parent."""
        shared = {g.id for g in self.groups(group)}
        return math.prod(self.dop(g) for g in self.groups(node) if g.id not in shared)

    def dops(self, node: Node) -> list[int]:
        own = [self.dop(g) for g in self.groups(node)]
        return own + ([self._number(node, None)] if node.category == "MPI" else [])

    def validate(self) -> None:
        """Raise GraphError where a link or a nesting is not allowed."""
        for n in self.nodes.values():
            for g in self.groups(n):
                if n.group and g.category not in NESTING:
                    raise GraphError(f"{n.id}: {g.category} holds no groups")
        for x in self.links:
            a, b = self.nodes[x.src], self.nodes[x.dst]
            if a.category in ("Scatter", "Loop") or b.category in ("Scatter", "Loop"):
                raise GraphError(f"{x.src} -> {x.dst}: a construct is no end of a link")
            ga, gb = self.groups(a), self.groups(b)
            loops = [[g for g in gs if g.category == "Loop"] for gs in (ga, gb)]
            if loops[0] and loops[1] and loops[0] != loops[1] and not x.loop_aware and {g.parent for g in loops[0][:1]} == {g.parent for g in loops[1][:1]}:
                if self.dop(loops[0][-1]) != self.dop(loops[1][-1]):
                    raise GraphError(f"{x.src} -> {x.dst}: loops of different counts")


def flat(total: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(total - 1))).alias("idx")


def iid_of(idx: Column, dops: Column) -> Column:
    """Index path of a flat index: the reverse of row-major order."""
    back = F.aggregate(
        F.reverse(dops), F.struct(idx.alias("rest"), F.expr("cast(array() as array<int>)").alias("path")),
        lambda a, d: F.struct(F.floor(a["rest"] / d).cast("long").alias("rest"), F.concat(F.array((a["rest"] % d).cast("int")), a["path"]).alias("path")), lambda a: a["path"],
    )
    return back


def unroll_nodes(spark: SparkSession, graph: LogicalGraph, session: str = "s") -> DataFrame:
    """One row per instance: oid, lg_key, iid, name, category, kind, weight."""
    rows = []
    for n in graph.nodes.values():
        if not n.group:
            dops = graph.dops(n)
            rows.append((n.id, n.name, n.category, n.kind, [int(d) for d in dops], math.prod(dops), int(n.fields.get("weight") or n.fields.get("execution_time") or n.fields.get("data_volume") or 5)))
    lg = spark.createDataFrame(rows, "lg_key string, name string, category string, kind string, dops array<int>, total long, weight long")
    each = lg.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)))
    path = iid_of(F.col("idx"), F.col("dops"))
    return each.withColumn("iid", path).select(
        F.concat_ws("_", F.lit(session), "lg_key", F.concat_ws("-", F.lit("0"), F.transform("iid", lambda x: x.cast("string")))).alias("oid"), "lg_key", "idx", "iid", "name", "category", "kind", "weight",
    )


def edge_pairs(spark: SparkSession, graph: LogicalGraph) -> DataFrame:
    """(src_key, src_idx, dst_key, dst_idx, port, is_stream) of all links."""
    parts = []
    for x in graph.links:
        a, b = graph.nodes[x.src], graph.nodes[x.dst]
        ga, gb = graph.groups(a), graph.groups(b)
        m, n = math.prod(graph.dops(a)), math.prod(graph.dops(b))
        base = spark.range(max(m, n)).withColumnRenamed("id", "i")
        loop_a, loop_b = [[g for g in gs if g.category == "Loop"] for gs in (ga, gb)]
        grouped = [g for g in gb if g.category == "GroupBy" and g not in ga]
        gathered = [g for g in gb if g.category == "Gather" and g not in ga]
        if loop_a and loop_a == loop_b and a.end and b.start:
            k = graph.dop(loop_a[-1])  # closure: iteration j feeds j + 1
            inner = m // math.prod(graph.dop(g) for g in ga[: ga.index(loop_a[-1]) + 1])
            pairs = spark.range(m).select(F.col("id").alias("s"), (F.col("id") + inner).alias("d")).where(F.floor(F.col("s") / inner) % k < k - 1)
        elif loop_a and loop_a[-1] not in gb and x.loop_aware:
            k = graph.dop(loop_a[-1])  # out of a loop: the last iteration
            inner = m // math.prod(graph.dop(g) for g in ga[: ga.index(loop_a[-1]) + 1])
            pairs = spark.range(m).where(F.floor(F.col("id") / inner) % k == k - 1).select(F.col("id").alias("s"), F.floor(F.col("id") / max(1, m // n)).cast("long").alias("d"))
        elif loop_b and loop_b[-1] not in ga and x.loop_aware:
            k = graph.dop(loop_b[-1])  # into a loop: the first iteration
            inner = n // math.prod(graph.dop(g) for g in gb[: gb.index(loop_b[-1]) + 1])
            pairs = spark.range(n).where(F.floor(F.col("id") / inner) % k == 0).select(F.floor(F.col("id") / max(1, n // m)).cast("long").alias("s"), F.col("id").alias("d"))
        elif grouped:
            layers = [g.id for g in ga]
            dops = graph.dops(a)
            keep = [layers.index(k) for k in graph.keys(grouped[0])]
            outer = [i for i, g in enumerate(ga) if g in gb]
            iid = iid_of(F.col("id"), F.array(*[F.lit(d) for d in dops]))
            at = F.lit(0).cast("long")
            for i in [*outer, *keep]:
                at = at * dops[i] + F.get("iid", F.lit(i))
            pairs = spark.range(m).withColumn("iid", iid).select(F.col("id").alias("s"), at.alias("d"))
        elif gathered:
            width = graph._number(gathered[0], 1)
            relative = graph.relative(a, gathered[0])
            per = graph.dop(gathered[0])
            pairs = spark.range(m).select(F.col("id").alias("s"), (F.floor(F.col("id") / relative) * per + F.floor((F.col("id") % relative) / width)).cast("long").alias("d"))
        else:
            top = max(m, n)
            pairs = base.select(F.floor(F.col("i") * m / top).cast("long").alias("s"), F.floor(F.col("i") * n / top).cast("long").alias("d"))
        parts.append(pairs.select(F.lit(x.src).alias("src_key"), F.col("s").cast("long").alias("src_idx"), F.lit(x.dst).alias("dst_key"), F.col("d").cast("long").alias("dst_idx"), F.lit(x.port).alias("port"), F.lit(x.port.endswith("stream")).alias("is_stream")))
    out = None
    for p in parts:
        out = p if out is None else out.unionAll(p)
    if out is None:
        return spark.createDataFrame([], "src_key string, src_idx long, dst_key string, dst_idx long, port string, is_stream boolean")
    return out


def unroll(spark: SparkSession, graph: LogicalGraph, session: str = "s") -> tuple[DataFrame, DataFrame]:
    """nodes and edges of the physical graph template."""
    nodes = unroll_nodes(spark, graph, session)
    key = nodes.select("lg_key", "idx", "oid")
    src, dst = key.select(F.col("lg_key").alias("src_key"), F.col("idx").alias("src_idx"), F.col("oid").alias("src")), key.select(F.col("lg_key").alias("dst_key"), F.col("idx").alias("dst_idx"), F.col("oid").alias("dst"))
    edges = edge_pairs(spark, graph).join(src, ["src_key", "src_idx"]).join(dst, ["dst_key", "dst_idx"]).select("src", "dst", "port", "is_stream")
    return nodes.drop("idx"), edges


# ---- the constructs over plain tables


def scatter_rows(df: DataFrame, k: int, name: str = "copy") -> DataFrame:
    """Every row k times."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def gather_rows(df: DataFrame, idx: str, width: int, *aggs: Column) -> DataFrame:
    """Chunks of `width` consecutive indexes."""
    return df.groupBy(F.floor(F.col(idx) / width).cast("long").alias("gather")).agg(*aggs)


def corner_turn(df: DataFrame, inner: str | list[str], *aggs: Column) -> DataFrame:
    """[outer][inner] regrouped by inner, by one key or several."""
    return df.groupBy(*([inner] if isinstance(inner, str) else inner)).agg(*aggs)


def group_order(keys: DataFrame, key: str) -> DataFrame:
    """Group keys with their target index, in the order of their text; the keys are few
    (one row a group), the rows are not touched."""
    from pyspark.sql import Window

    return keys.select(key).distinct().withColumn("target", F.row_number().over(Window.orderBy(F.col(key).cast("string"))) - 1)


def mkn(df: DataFrame, idx: str, m: int, k: int, n: int) -> DataFrame:
    """M inputs through K internal nodes to N outputs: (out, row) with one row for each output
    of each input's internal node.  K divides M or M divides K, likewise K and N."""
    for a, b in ((m, k), (k, n)):
        if max(a, b) % min(a, b):
            raise ValueError("M, K and N must be in whole ratios")
    internal = df.withColumn("k", F.explode(F.sequence(F.floor((F.col(idx) % m) * k / m), F.greatest(F.floor((F.col(idx) % m) * k / m), F.floor(((F.col(idx) % m) + 1) * k / m) - 1))))
    return internal.withColumn("out", F.explode(F.sequence(F.floor(F.col("k") * n / k), F.greatest(F.floor(F.col("k") * n / k), F.floor((F.col("k") + 1) * n / k) - 1))))


def loop(df: DataFrame, n: int, step, keep: str = "all") -> DataFrame:
    """Apply step(df, i) n times; all iterations with their number, or the last alone.  The
    loop is unrolled into one lazy plan; long loops cut their lineage every 10 rounds."""
    from ..shared import cut

    out, now = None, df
    for i in range(n):
        now = step(now, i)
        if i % 10 == 9:
            now = cut(now, "loop")
        tagged = now.withColumn("iter", F.lit(i))
        out = tagged if out is None or keep == "last" else out.unionByName(tagged)
    return out


def lockstep(a: DataFrame, b: DataFrame, iteration: str = "iter", on: tuple = ()) -> DataFrame:
    """Two sibling loops joined on equal iterations."""
    return a.join(b, [iteration, *on])


def substitute_mkn(text: str, m: int, k: int, n: int) -> str:
    return re.sub(r"%([mkn])", lambda x: str({"m": m, "k": k, "n": n}[x[1]]), text)


def sequence_gathers(pairs: DataFrame, width: int) -> DataFrame:
    """(gather, waits_for): gather i opens the next window of `width` sources once it is done,
    so a source of window i + 1 waits for gather i; the first window waits for nothing.
    pairs(src_idx, dst_idx) as of edge_pairs()."""
    window = F.floor(F.col("src_idx") / width).cast("long")
    return pairs.select("src_idx", window.alias("gather"), F.when(window > 0, window - 1).alias("waits_for"))


def synthesised(graph: LogicalGraph) -> list[Node]:
    """Drops that a construct brings with it: a GroupBy and a Gather each a waiting
    application and the data that it hands on."""
    out = []
    for n in graph.nodes.values():
        if n.category in ("GroupBy", "Gather"):
            kind = "grp-data" if n.category == "GroupBy" else "gather-data"
            out += [Node(f"{n.id}-app", f"{n.name} wait", "SleepApp", n.id), Node(f"{n.id}-{kind}", kind, "Memory", n.id, "data")]
    return out


def without_services(graph: LogicalGraph) -> list[Link]:
    """Links that stay: those of a Service are ignored, of which only the input application
    is kept."""
    return [x for x in graph.links if "Service" not in (graph.nodes[x.src].category, graph.nodes[x.dst].category)]


def split_construct(construct: Node, input_app: str | None, output_app: str | None) -> tuple[list[Node], list[Link]]:
    """A construct with applications of its own as a plain group and application nodes:
    the input application before the group, the output application after it."""
    group = Node(construct.id, construct.name, construct.category, construct.parent, construct.kind, dict(construct.fields))
    nodes, links = [group], []
    if input_app:
        nodes.append(Node(f"{construct.id}-in", input_app, "PythonApp", construct.parent))
    if output_app:
        nodes.append(Node(f"{construct.id}-out", output_app, "PythonApp", construct.id if construct.category == "Gather" else construct.parent))
    return nodes, links

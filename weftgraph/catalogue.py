"""The registered queries over the driver's tables, each with its oracle SQL.

Amounts are summed as whole cents, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import apps, checksums, scalars
from .operators import arrays, gating, graph, lifecycle, provenance, relational
from .plans import partition, prepare, unroll
from .shared import shared_path, ship
from .sources import stores

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


CENTS = "CAST(round({} * 100) AS BIGINT)"

# ---- arrays


def _tiles(spark, d):
    return arrays.scatter(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 4, ["l_orderkey", "l_linenumber"])


@query("SELECT CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem")
def reduce_gather_sum(spark, d):
    return arrays.reduce_gather(_tiles(spark, d), "tile", F.col("l_quantity"), "sum").select(F.col("value").cast("long").alias("value"))


@query("SELECT CAST(min(l_quantity) AS BIGINT) AS value FROM lineitem")
def reduce_gather_min(spark, d):
    return arrays.reduce_gather(_tiles(spark, d), "tile", F.col("l_quantity"), "min").select(F.col("value").cast("long").alias("value"))


@query("SELECT CAST(max(l_quantity) AS BIGINT) AS value FROM lineitem")
def reduce_gather_max(spark, d):
    return arrays.reduce_gather(_tiles(spark, d), "tile", F.col("l_quantity"), "max").select(F.col("value").cast("long").alias("value"))


@query("SELECT CAST(product(n_regionkey + 1) AS DOUBLE) AS value FROM nation")
def reduce_gather_prod(spark, d):
    return arrays.reduce_gather(t(spark, d, "nation"), "n_regionkey", F.col("n_regionkey") + 1, "prod").select(F.col("value").cast("double").alias("value"))


_SPLIT = "SELECT *, CAST(ntile(4) OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS tile FROM orders"


@query(f"SELECT tile, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM ({_SPLIT}) GROUP BY tile")
def scatter_split(spark, d):
    tiles = arrays.scatter(t(spark, d, "orders").select("o_orderkey"), 4, ["o_orderkey"])
    return tiles.groupBy("tile").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query(f"SELECT tile, min_by(o_orderkey, o_orderkey) AS o_orderkey, min_by(o_custkey, o_orderkey) AS o_custkey FROM ({_SPLIT}) GROUP BY tile")
def scatter_first_element(spark, d):
    return arrays.first_of_each(arrays.scatter(t(spark, d, "orders").select("o_orderkey", "o_custkey"), 4, ["o_orderkey"]), "tile", "o_orderkey", "o_orderkey", "o_custkey")


@query("SELECT tile, count(*) AS n, CAST(max(v) AS DOUBLE) AS top FROM (SELECT unnest(embedding) AS v, CAST((generate_subscripts(embedding, 1) - 1) // 16 AS BIGINT) AS tile FROM embeddings) GROUP BY tile")
def npy_scatter_axis(spark, d):
    long = t(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return arrays.scatter_axis(long, "pos", 64, 4).groupBy("tile").agg(F.count("*").alias("n"), F.max("v").cast("double").alias("top"))


@query("SELECT CAST((rn - 1) // 1000 AS BIGINT) AS chunk, CAST(sum(l_quantity) AS BIGINT) AS total, count(*) AS n FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) GROUP BY 1")
def gather_chunks(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return arrays.gather_chunks(li, 1000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity").cast("long"))


@query("SELECT 0 AS input_no, n_name AS name FROM nation UNION ALL SELECT 1, r_name FROM region")
def gather_concat(spark, d):
    return arrays.concat(t(spark, d, "nation").select(F.col("n_name").alias("name")), t(spark, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def copy_all(spark, d):
    both = arrays.concat(t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    to = shared_path(spark, "copies")
    stores.copy(both.drop("input_no"), to)
    return spark.read.parquet(to)


@query("SELECT n_nationkey, k, v FROM (SELECT n_nationkey, 'nation' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'source', 'tpch' FROM nation)")
def dict_gather(spark, d):
    both = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = arrays.dict_gather({"nation": F.col("n_name"), "region": F.col("r_name"), "id": F.col("n_nationkey")}, both, {"source": "tpch", "empty": "", "region": "ignored"})
    return one.select(F.col("value")["id"].cast("int").alias("n_nationkey"), F.explode(F.map_filter("value", lambda k, v: k != "id")).alias("k", "v"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def array_gather(spark, d):
    return arrays.array_gather(t(spark, d, "nation"), ["n_regionkey"], "n_name", "n_nationkey").select("n_regionkey", F.array_join("value", ",").alias("names"))





_EW = "SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding) AS v FROM embeddings"


@query(f"SELECT label, pos, CAST(sum(CAST(round(CAST(v AS DOUBLE) * 1000000) AS BIGINT)) AS BIGINT) AS value FROM ({_EW}) GROUP BY 1, 2")
def elementwise_add(spark, d):
    micro = t(spark, d, "embeddings").withColumn("e", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long")))
    return arrays.elementwise(micro, "e", "add", "label").withColumn("value", F.col("value").cast("long"))


@query(f"SELECT label, pos, CAST(max(v) AS DOUBLE) AS value FROM ({_EW}) GROUP BY 1, 2")
def elementwise_max(spark, d):
    return arrays.elementwise(t(spark, d, "embeddings"), "embedding", "maximum", "label")


@query(f"SELECT label, pos, CAST(min(v) AS DOUBLE) AS value FROM ({_EW}) GROUP BY 1, 2")
def elementwise_min(spark, d):
    return arrays.elementwise(t(spark, d, "embeddings"), "embedding", "minimum", "label")


@query(f"SELECT label, pos, CAST(product(CASE WHEN v < 0 THEN -1 ELSE 1 END) AS DOUBLE) AS value FROM ({_EW}) GROUP BY 1, 2")
def elementwise_multiply(spark, d):
    signs = t(spark, d, "embeddings").withColumn("s", F.transform("embedding", lambda x: F.when(x < 0, -1).otherwise(1)))
    return arrays.elementwise(signs, "s", "multiply", "label")


@query("SELECT CAST(sum(" + CENTS.format("o_totalprice") + ") AS DOUBLE) / count(*) AS value FROM orders")
def average_mean(spark, d):
    return arrays.average(t(spark, d, "orders"), cents("o_totalprice"))


@query("SELECT median(o_totalprice) AS value FROM orders")
def average_median(spark, d):
    return arrays.average(t(spark, d, "orders"), F.col("o_totalprice"), "median")


@query(f"SELECT pos, median(CAST(v AS DOUBLE)) AS value FROM ({_EW}) GROUP BY 1")
def average_elementwise(spark, d):
    return arrays.average_elementwise(t(spark, d, "embeddings"), "embedding", "median")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1")
def pick_one(spark, d):
    return arrays.pick_first(t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1")
def pick_rest(spark, d):
    return arrays.pick_rest(t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


@query("SELECT 'Hello, ' || r_name AS greeting FROM region")
def hello_world(spark, d):
    return t(spark, d, "region").select(scalars.hello(F.col("r_name")).alias("greeting"))


@query("SELECT 100 AS n, true AS within")
def random_array(spark, d):
    return arrays.random_array(spark, 100, 5, 50).agg(F.count("*").cast("int").alias("n"), F.bool_and((F.col("value") >= 5) & (F.col("value") < 50)).alias("within"))


@query("SELECT 40000 AS n")
def list_thrash(spark, d):
    return arrays.list_thrash(spark, 200).select(F.col("n").cast("int").alias("n"))


# ---- constructs


@query("SELECT l_linenumber, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def groupby_corner_turn(spark, d):
    return unroll.corner_turn(t(spark, d, "lineitem"), "l_linenumber", F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query("SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2")
def groupby_multikey(spark, d):
    return unroll.corner_turn(t(spark, d, "lineitem"), ["l_linenumber", "l_returnflag"], F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n_groups, max(n) AS largest FROM (SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def groupby_chain(spark, d):
    return unroll.corner_turn(groupby_multikey(spark, d), "l_returnflag", F.count("*").alias("n_groups"), F.max("n").alias("largest"))


@query("SELECT k, CAST(row_number() OVER (ORDER BY CAST(k AS VARCHAR)) - 1 AS INTEGER) AS target FROM (SELECT DISTINCT n_nationkey AS k FROM nation)")
def group_key_order(spark, d):
    return unroll.group_order(t(spark, d, "nation").select(F.col("n_nationkey").alias("k")), "k")


@query("WITH RECURSIVE r AS (SELECT c_custkey, " + CENTS.format("c_acctbal") + " AS bal, 0 AS iter FROM customer UNION ALL SELECT c_custkey, bal * 2 + c_custkey, iter + 1 FROM r WHERE iter < 4) SELECT c_custkey, CAST(bal AS BIGINT) AS bal, iter FROM r")
def loop_unroll(spark, d):
    start = t(spark, d, "customer").select("c_custkey", cents("c_acctbal").alias("bal"))
    return unroll.loop(start, 5, lambda df, i: df if i == 0 else df.select("c_custkey", (F.col("bal") * 2 + F.col("c_custkey")).alias("bal")))


@query("SELECT c_custkey, " + CENTS.format("c_acctbal") + " AS bal FROM customer")
def loop_first_edge(spark, d):
    return loop_unroll(spark, d).where("iter = 0").select("c_custkey", "bal")


@query("WITH RECURSIVE r AS (SELECT c_custkey, " + CENTS.format("c_acctbal") + " AS bal, 0 AS iter FROM customer UNION ALL SELECT c_custkey, bal * 2 + c_custkey, iter + 1 FROM r WHERE iter < 4) SELECT c_custkey, CAST(bal AS BIGINT) AS bal FROM r WHERE iter = 4")
def loop_last_edge(spark, d):
    return loop_unroll(spark, d).where("iter = 4").select("c_custkey", "bal")


@query("SELECT o_orderkey % 5 AS iter, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_orderkey % 5 = l_linenumber % 5 GROUP BY 1")
def loop_lockstep(spark, d):
    o = t(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("iter"), F.col("o_orderkey").alias("k"))
    li = t(spark, d, "lineitem").select((F.col("l_linenumber") % 5).cast("long").alias("iter"), F.col("l_orderkey").alias("k"))
    return unroll.lockstep(o, li, "iter", ("k",)).groupBy("iter").agg(F.count("*").alias("n"))


@query("SELECT CAST(k.k AS BIGINT) AS k, CAST(o.o AS BIGINT) AS out, count(*) AS n FROM supplier JOIN generate_series(0, 1) AS k(k) ON (s_suppkey % 4) * 2 // 4 = k.k JOIN generate_series(0, 7) AS o(o) ON o.o // 4 = k.k GROUP BY 1, 2")
def mkn(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    return unroll.mkn(s, "i", 4, 2, 8).groupBy("k", "out").agg(F.count("*").alias("n"))


def _nested() -> unroll.LogicalGraph:
    n = unroll.Node
    return unroll.LogicalGraph(
        [n("o", "outer", "Scatter", fields={"num_of_copies": 5}), n("i", "inner", "Scatter", "o", fields={"num_of_copies": 4}), n("m", "middle", "PythonApp", "o"), n("x", "leaf", "File", "i", "data"),
         n("g", "gather", "Gather", fields={"num_of_inputs": 2}), n("y", "sum", "PythonApp", "g")],
        [unroll.Link("m", "x"), unroll.Link("x", "y")],
    )


@query("SELECT lg_key, i0, i1 FROM (SELECT 'm' AS lg_key, CAST(a.a AS INTEGER) AS i0, -1 AS i1 FROM generate_series(0, 4) AS a(a) UNION ALL SELECT 'x', CAST(a.a AS INTEGER), CAST(b.b AS INTEGER) FROM generate_series(0, 4) AS a(a), generate_series(0, 3) AS b(b) UNION ALL SELECT 'y', CAST(a.a AS INTEGER), -1 FROM generate_series(0, 9) AS a(a))")
def unroll_nodes(spark, d):
    return unroll.unroll_nodes(spark, _nested()).select("lg_key", F.get("iid", F.lit(0)).alias("i0"), F.coalesce(F.get("iid", F.lit(1)), F.lit(-1)).alias("i1"))


@query("SELECT 's_m_0-' || CAST(i // 4 AS VARCHAR) AS src, 's_x_0-' || CAST(i // 4 AS VARCHAR) || '-' || CAST(i % 4 AS VARCHAR) AS dst FROM generate_series(0, 19) AS t(i) UNION ALL SELECT 's_x_0-' || CAST(i // 4 AS VARCHAR) || '-' || CAST(i % 4 AS VARCHAR), 's_y_0-' || CAST(i // 2 AS VARCHAR) FROM generate_series(0, 19) AS t(i)")
def unroll_edges(spark, d):
    return unroll.unroll(spark, _nested())[1].select("src", "dst")


@query("SELECT 's_a_0-' || j AS src, 's_d_0-' || j AS dst FROM generate_series(0, 2) AS t(j) UNION ALL SELECT 's_d_0-' || j, 's_a_0-' || (j + 1) FROM generate_series(0, 1) AS t(j) UNION ALL SELECT 's_d_0-2', 's_o_0' UNION ALL SELECT 's_i_0', 's_a_0-0'")
def unroll_loop(spark, d):
    n, x = unroll.Node, unroll.Link
    g = unroll.LogicalGraph(
        [n("l", "loop", "Loop", fields={"num_of_iter": 3}), n("a", "app", "PythonApp", "l", start=True), n("d", "data", "File", "l", "data", end=True), n("o", "out", "PythonApp"), n("i", "in", "File", None, "data")],
        [x("a", "d"), x("d", "a"), x("d", "o", loop_aware=True), x("i", "a", loop_aware=True)],
    )
    return unroll.unroll(spark, g)[1].select("src", "dst")


@query("SELECT 's_d_0-' || x || '-' || y || '-' || z AS src, 's_a_0-' || (x * 4 + z) AS dst FROM generate_series(0, 1) AS a(x), generate_series(0, 2) AS b(y), generate_series(0, 3) AS c(z)")
def unroll_groupby(spark, d):
    n = unroll.Node
    g = unroll.LogicalGraph(
        [n("o", "outer", "Scatter", fields={"num_of_copies": 2}), n("i", "inner", "Scatter", "o", fields={"num_of_copies": 3}), n("j", "innermost", "Scatter", "i", fields={"num_of_copies": 4}), n("d", "data", "File", "j", "data"),
         n("b", "by", "GroupBy", fields={"group_key": "o,j"}), n("a", "app", "PythonApp", "b")],
        [unroll.Link("d", "a")],
    )
    return unroll.unroll(spark, g)[1].select("src", "dst")


@query("SELECT 's_a_0-' || i AS src, 's_b_0-' || i AS dst FROM generate_series(0, 2) AS t(i)")
def unroll_service(spark, d):
    n, x = unroll.Node, unroll.Link
    g = unroll.LogicalGraph([n("v", "service", "Service"), n("s", "scatter", "Scatter", fields={"num_of_copies": 3}), n("a", "app", "PythonApp", "s"), n("b", "out", "File", "s", "data")], [x("v", "a"), x("a", "b")])
    return unroll.unroll(spark, g)[1].select("src", "dst")


@query("SELECT * FROM (VALUES ('sub', 's_sub_0'), ('out', 's_out_0')) AS t(lg_key, oid)")
def unroll_subgraph(spark, d):
    made = {
        "nodeDataArray": [{"id": "sub", "category": "SubGraph", "fields": []}, {"id": "in", "category": "PythonApp", "parentId": "sub", "fields": []}, {"id": "out", "category": "File", "categoryType": "Data", "fields": []}],
        "linkDataArray": [{"from": "in", "to": "out"}, {"from": "sub", "to": "out"}],
    }
    return unroll.unroll_nodes(spark, unroll.LogicalGraph.from_json(prepare.prepared(made))).select("lg_key", "oid")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def branch_true(spark, d):
    return gating.branch(t(spark, d, "orders"), F.col("o_totalprice") > 100000)[0].select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def branch_false(spark, d):
    return gating.branch(t(spark, d, "orders"), F.col("o_totalprice") > 100000)[1].select("o_orderkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10 AND s_acctbal > 0")
def rdbms_select(spark, d):
    return relational.Table(spark, "supplier_rel", t(spark, d, "supplier")).select(["s_suppkey", "s_name"], "s_nationkey < {} AND s_acctbal > {}", (10, 0))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT -1, 'hello', NULL")
def rdbms_insert(spark, d):
    return relational.Table(spark, "supplier_ins", t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")).insert({"s_suppkey": -1, "s_name": "hello"})


# ---- graphs: region -> nation -> customer -> order -> line

_NODES = """
SELECT 'r' || r_regionkey AS oid, CAST(r_regionkey % 3 + 1 AS BIGINT) AS weight FROM region UNION ALL SELECT 'n' || n_nationkey, CAST(n_nationkey % 5 + 1 AS BIGINT) FROM nation
UNION ALL SELECT 'c' || c_custkey, CAST(c_custkey % 7 + 1 AS BIGINT) FROM customer UNION ALL SELECT 'o' || o_orderkey, CAST(o_orderkey % 11 + 1 AS BIGINT) FROM orders"""
_EDGES = """
SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, CAST(n_nationkey % 4 AS BIGINT) AS weight FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, CAST(c_custkey % 6 AS BIGINT) FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, CAST(o_orderkey % 9 AS BIGINT) FROM orders"""


def _graph(spark, d):
    """nodes(oid, weight), edges(src, dst, weight) of the key hierarchy."""
    def ids(prefix, c):
        return F.concat(F.lit(prefix), F.col(c))
    r, n, c, o = (t(spark, d, x) for x in ("region", "nation", "customer", "orders"))
    w = lambda c, k: (F.col(c) % k + 1).cast("long").alias("weight")
    e = lambda c, k: (F.col(c) % k).cast("long").alias("weight")
    nodes = r.select(ids("r", "r_regionkey").alias("oid"), w("r_regionkey", 3)).unionAll(n.select(ids("n", "n_nationkey"), w("n_nationkey", 5))).unionAll(c.select(ids("c", "c_custkey"), w("c_custkey", 7))).unionAll(o.select(ids("o", "o_orderkey"), w("o_orderkey", 11)))
    edges = (
        n.select(ids("r", "n_regionkey").alias("src"), ids("n", "n_nationkey").alias("dst"), e("n_nationkey", 4))
        .unionAll(c.select(ids("n", "c_nationkey"), ids("c", "c_custkey"), e("c_custkey", 6))).unionAll(o.select(ids("c", "o_custkey"), ids("o", "o_orderkey"), e("o_orderkey", 9)))
    )
    return nodes, edges


@query(f"WITH n AS ({_NODES}), e AS ({_EDGES}) SELECT oid FROM n WHERE oid NOT IN (SELECT dst FROM e)")
def graph_roots(spark, d):
    return graph.roots(*_graph(spark, d)).select("oid")


@query(f"WITH n AS ({_NODES}), e AS ({_EDGES}) SELECT oid FROM n WHERE oid NOT IN (SELECT src FROM e)")
def graph_leaves(spark, d):
    return graph.leaves(*_graph(spark, d)).select("oid")


@query(f"WITH n AS ({_NODES}), e AS ({_EDGES}) SELECT oid, (SELECT count(*) FROM e WHERE dst = oid) AS n_in, (SELECT count(*) FROM e WHERE src = oid) AS n_out FROM n")
def graph_degrees(spark, d):
    return graph.degrees(*_graph(spark, d)).select("oid", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"))


@query(f"WITH e AS ({_EDGES}) SELECT DISTINCT dst AS oid, src AS neighbour FROM e")
def graph_upstream(spark, d):
    return graph.neighbours(_graph(spark, d)[1], "up")


_BFS = f"WITH RECURSIVE e AS ({_EDGES}), r(oid, depth) AS (SELECT 'r0', 0 UNION ALL SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.oid)"


@query(f"{_BFS} SELECT oid, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1")
def bfs_depth(spark, d):
    return graph.bfs(_graph(spark, d)[1], spark.createDataFrame([("r0",)], "oid string"))


@query(f"{_BFS} SELECT DISTINCT oid FROM r WHERE depth > 0")
def reachability(spark, d):
    return bfs_depth(spark, d).where("depth > 0").select("oid")


_LABEL = f"WITH RECURSIVE n AS ({_NODES}), e AS ({_EDGES}), r(oid, stt) AS (SELECT oid, CAST(0 AS BIGINT) FROM n UNION ALL SELECT e.dst, r.stt + p.weight + e.weight FROM r JOIN e ON e.src = r.oid JOIN n p ON p.oid = r.oid), s AS (SELECT oid, max(stt) AS stt FROM r GROUP BY 1)"


@query(f"{_LABEL} SELECT s.oid, stt, stt + weight AS edt FROM s JOIN n ON n.oid = s.oid")
def label_schedule(spark, d):
    return graph.label_schedule(*_graph(spark, d))


@query(f"{_LABEL} SELECT s.oid, stt + weight AS length FROM s JOIN n ON n.oid = s.oid")
def longest_path(spark, d):
    return graph.longest_path(*_graph(spark, d))


@query(f"{_LABEL}, g AS (SELECT unnest(generate_series(stt, stt + weight - 1)) AS t FROM s JOIN n ON n.oid = s.oid) SELECT t, count(*) AS busy FROM g GROUP BY 1")
def gantt_load(spark, d):
    return graph.gantt(label_schedule(spark, d)).groupBy("t").agg(F.count("*").alias("busy"))


@query("SELECT CAST(sum(" + CENTS.format("o_totalprice") + ") AS BIGINT) AS movement FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> o_orderkey % 25")
def data_movement(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    edges = o.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), cents("o_totalprice").alias("weight"))
    parts = o.select(F.concat(F.lit("o"), "o_orderkey").alias("oid"), (F.col("o_orderkey") % 25).cast("long").alias("part")).unionAll(c.select(F.concat(F.lit("c"), "c_custkey"), F.col("c_nationkey").cast("long")))
    return graph.data_movement(edges, parts)


@query("SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders WHERE o_custkey % 10 = 0 OR o_orderkey % 7 = 0")
def unmet_relations(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    there = c.where("c_custkey % 10 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("oid")).unionAll(o.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("o"), "o_orderkey")))
    return graph.unmet_relations(there, edges)


@query("WITH x AS (SELECT c_nationkey % 4 AS a, o_orderkey % 4 AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> o_orderkey % 4 GROUP BY 1, 2) SELECT CAST(a AS BIGINT) AS host_a, CAST(b AS BIGINT) AS host_b, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a, b, n FROM x UNION ALL SELECT b, a, n FROM x) GROUP BY 1, 2")
def relations_by_node_pair(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"))
    hosts = c.select(F.concat(F.lit("c"), "c_custkey").alias("oid"), (F.col("c_nationkey") % 4).cast("long").alias("host")).unionAll(o.select(F.concat(F.lit("o"), "o_orderkey"), (F.col("o_orderkey") % 4).cast("long")))
    return graph.relations_by_node_pair(edges, hosts)


@query("SELECT c_nationkey AS node, count(*) AS n_uids FROM customer GROUP BY 1")
def uids_by_node(spark, d):
    return graph.group_by_host(t(spark, d, "customer").withColumnRenamed("c_nationkey", "node"))


@query("SELECT CAST(p AS BIGINT) AS p, CAST(q AS BIGINT) AS q, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT c_nationkey % 3 AS p, o_orderkey % 3 AS q, o_orderkey % 9 AS w FROM orders JOIN customer ON o_custkey = c_custkey) WHERE p <> q GROUP BY 1, 2")
def merge_partitions(spark, d):
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    edges = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), (F.col("o_orderkey") % 9).cast("long").alias("weight"))
    parts = c.select(F.concat(F.lit("c"), "c_custkey").alias("oid"), (F.col("c_nationkey") % 3).cast("long").alias("part")).unionAll(o.select(F.concat(F.lit("o"), "o_orderkey"), (F.col("o_orderkey") % 3).cast("long")))
    return partition.merge_partitions(edges, parts)


@query("SELECT s_suppkey AS oid, 'w' || CAST(s_suppkey % 3 AS VARCHAR) AS node, 'i0' AS island FROM supplier")
def map_nodes(spark, d):
    parts = t(spark, d, "supplier").select(F.col("s_suppkey").alias("oid"), F.col("s_suppkey").alias("part"))
    return partition.map_to_nodes(parts, ["i0", "w0", "w1", "w2"], 1).drop("part")


# ---- gating

_STATUS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'writing' ELSE 'completed' END"


def _inputs(spark, d):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "view", "writing").otherwise("completed")
    return t(spark, d, "events").select(F.col("user_id").alias("app"), "ts", "event_id", status.alias("status"))


@query(f"SELECT user_id AS app, count(*) AS n_inputs, count(*) FILTER ({_STATUS} <> 'writing') AS n_done, bool_and({_STATUS} <> 'writing') AS fired FROM events GROUP BY 1")
def barrier_fire(spark, d):
    return gating.barrier(_inputs(spark, d))


@query(f"SELECT app, event_id FROM (SELECT user_id AS app, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE {_STATUS} <> 'writing') WHERE rn <= 3")
def k_of_n_fire(spark, d):
    return gating.effective(_inputs(spark, d), 3, ["ts", "event_id"]).select("app", "event_id")


_FIRE = f"""
WITH x AS (SELECT user_id AS app, ts, event_id, {_STATUS} AS status FROM events),
u AS (SELECT app, count(*) AS n_done, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status = 'skipped') AS n_skipped FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY ts, event_id) AS rn FROM x WHERE status <> 'writing') WHERE rn <= 4 GROUP BY 1)
SELECT a.app, coalesce(n_done, 0) AS n_done, coalesce(n_error, 0) AS n_error, coalesce(n_skipped, 0) AS n_skipped,
CASE WHEN coalesce(n_done, 0) < 4 THEN 'waiting' WHEN 100 * n_error // 4 > 30 THEN 'error' WHEN {{}} THEN 'skipped' ELSE 'run' END AS outcome FROM (SELECT DISTINCT app FROM x) a LEFT JOIN u USING (app)"""


@query(_FIRE.format("n_skipped > 0"))
def error_threshold(spark, d):
    return gating.fire(_inputs(spark, d), 4, 30, ["ts", "event_id"])


@query(_FIRE.format("n_skipped = n_done"))
def skip_propagation(spark, d):
    return gating.fire(_inputs(spark, d), 4, 30, ["ts", "event_id"], block_skip=True)


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_status(spark, d):
    return gating.latest_status(t(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT user_id AS data, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error' WHEN count(*) FILTER (event_type = 'view') = 0 THEN 'completed' ELSE 'waiting' END AS status FROM events GROUP BY 1")
def data_completion(spark, d):
    ev = t(spark, d, "events").select(F.col("user_id").alias("data"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "running").otherwise("finished").alias("status"))
    return gating.data_status(ev)


@query("SELECT user_id AS data, min(event_id) AS completed_at FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) * 10 AS written FROM events) WHERE written >= 30 GROUP BY 1")
def size_triggered(spark, d):
    chunks = t(spark, d, "events").select(F.col("user_id").alias("data"), F.col("event_id").alias("seq"), F.lit(10).alias("size"))
    return gating.sized_completion(chunks, 30)


@query(f"WITH n AS ({_NODES}), b AS (SELECT 'c' || c_custkey AS oid FROM customer WHERE c_acctbal < 0), o AS (SELECT 'o' || o_orderkey AS oid FROM orders WHERE 'c' || o_custkey IN (SELECT oid FROM b)) SELECT oid, CASE WHEN oid IN (SELECT oid FROM b) OR oid IN (SELECT oid FROM o) THEN 'error' ELSE 'completed' END AS status FROM n")
def status_fixpoint(spark, d):
    nodes, edges = _graph(spark, d)
    nodes = nodes.select("oid", F.when(F.substring("oid", 1, 1).isin("n", "o"), "data").otherwise("app").alias("kind"), F.lit(0).alias("threshold"))
    initial = t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("oid"), F.lit("completed").alias("status")).unionAll(t(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey"), F.lit("error")))
    return gating.propagate(nodes, edges, initial)


# ---- lifecycle


@query("SELECT o_orderkey AS oid FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")
def expire_after_use(spark, d):
    data = t(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("writing").alias("status"), (F.col("o_orderkey") % 3 == 0).alias("persist"), F.lit(True).alias("expire_after_use"))
    uses = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("oid"), (F.col("l_linestatus") == "F").alias("finished"))
    return lifecycle.expire_after_use(data, uses)


@query("SELECT o_orderkey AS oid FROM orders WHERE o_orderkey % 5 <> 0 AND epoch(o_orderdate) + 86400 * (o_orderkey % 100) < 800000000")
def expire_lifespan(spark, d):
    date = F.when(F.col("o_orderkey") % 5 == 0, -1.0).otherwise(F.unix_timestamp("o_orderdate").cast("double") + 86400 * (F.col("o_orderkey") % 100))
    return lifecycle.expire_lifespan(t(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), date.alias("expiration_date")), F.lit(800000000.0))


@query("SELECT p_partkey AS oid, count(l_orderkey) AS n, CASE count(l_orderkey) WHEN 0 THEN 'lost' WHEN 1 THEN 'replicate' ELSE 'none' END AS action FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 48 GROUP BY 1")
def lost_replicas(spark, d):
    return lifecycle.replicas(t(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("oid")), t(spark, d, "part").select(F.col("p_partkey").alias("oid")))


@query("SELECT user_id, max(ts) AS last_access FROM events GROUP BY 1")
def last_access(spark, d):
    return lifecycle.last_access(t(spark, d, "events"), "user_id")


@query("SELECT o_orderkey AS oid, CASE WHEN o_orderstatus = 'F' THEN 'deleted' ELSE 'completed' END AS status FROM orders")
def garbage_collect(spark, d):
    return lifecycle.garbage(t(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.when(F.col("o_orderstatus") == "F", "expired").otherwise("completed").alias("status")))


@query("SELECT o_orderkey AS oid, 'SOLID' AS phase FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0 AND o_totalprice <= 150000")
def replicate_completed(spark, d):
    data = t(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("writing").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("persist"), F.lit(False).alias("container"), F.col("o_totalprice").alias("size"))
    return lifecycle.replicate_on_completion(data, 150000).select("oid", "phase")


@query("SELECT user_id FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY 1) WHERE epoch((SELECT max(ts) FROM events)) - epoch(m) > 86400")
def tier_migration(spark, d):
    ev = t(spark, d, "events")
    now = ev.agg(F.max("ts").cast("timestamp").cast("double")).first()[0]
    return lifecycle.migrate(ev.select("user_id").distinct(), ev, F.lit(now), 86400, "user_id")


# ---- preparation, scalars


@query("SELECT p_partkey AS node, CASE WHEN p_partkey % 4 = 0 THEN 'cfg' || p_size ELSE p_brand END AS value FROM part")
def config_overlay(spark, d):
    p = t(spark, d, "part")
    fields = p.select(F.col("p_partkey").alias("node"), F.lit("brand").alias("field"), F.col("p_brand").alias("value"))
    cfg = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("node"), F.lit("brand").alias("field"), F.concat(F.lit("cfg"), "p_size").alias("value"))
    return prepare.overlay(fields, cfg).select("node", "value")


@query("SELECT p_partkey, CAST(p_size + 7 AS BIGINT) AS total, 'x=7;' || p_name AS text FROM part")
def global_substitution(spark, d):
    values = {"n": ("Integer", "7")}
    filled = prepare.global_column(F.concat(F.lit("x={n};"), F.col("p_name")), values)
    return t(spark, d, "part").select("p_partkey", (F.col("p_size") + prepare.global_column(F.lit("{n}"), values).cast("bigint")).alias("total"), filled.alias("text"))


@query("SELECT p_partkey, 'part 5 of ' || p_name AS text FROM part")
def parameter_fill(spark, d):
    return t(spark, d, "part").select("p_partkey", prepare.fill_column(F.concat(F.lit("part ~{a.b} of "), F.col("p_name")), {"a": {"b": 5}}).alias("text"))


@query("SELECT doc_id, regexp_replace(split_part(source || '_' || doc_id, '_', 1) || '_' || lang || ' ' || doc_id, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM documents")
def path_base_name(spark, d):
    return t(spark, d, "documents").select("doc_id", scalars.base_name(F.concat_ws("_", "source", "doc_id"), F.concat_ws(" ", "lang", "doc_id")).alias("name"))


@query("SELECT doc_id, substr(source, 1, 6) || '_' || substr(CAST(doc_id AS VARCHAR), 1, 6) AS short FROM documents")
def uid_short_key(spark, d):
    return t(spark, d, "documents").select("doc_id", scalars.short_key(F.concat_ws("_", "source", "doc_id")).alias("short"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')) AS n FROM documents".replace("len(", "CAST(len(").replace(") AS n", ") AS BIGINT) AS n"))
def read_words(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(scalars.read_words(F.col("text"))).cast("long").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def string2json(spark, d):
    ev = t(spark, d, "events").select("event_id", scalars.string_to_json(F.col("props")).alias("v"))
    return ev.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("SELECT CAST(i AS BIGINT) AS id FROM generate_series(3, 99, 4) AS t(i)")
def create_range(spark, d):
    made = apps.call(apps.REGISTRY["create_range"].function, {}, {"low": 3, "high": 100, "step": 4})
    return spark.createDataFrame([(i,) for i in made], "id long")


@query("SELECT p_partkey, CASE WHEN p_size IS NULL THEN NULL ELSE greatest(CAST(p_size AS BIGINT), p_partkey) END AS top FROM part")
def get_max(spark, d):
    return t(spark, d, "part").select("p_partkey", scalars.greatest_of(F.col("p_size").cast("long"), F.col("p_partkey")).alias("top"))


@query("SELECT s_suppkey, 'name=' || s_name || chr(10) || 'nation=' || s_nationkey AS text FROM supplier")
def parset_yanda(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", scalars.yanda(F.create_map(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("name"), F.col("s_name"))).alias("text"))


# ---- provenance, checksums


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, 1 AS mode, a.n_regionkey IS NOT DISTINCT FROM b.n_regionkey AS equal FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def signature_compare(spark, d):
    return provenance.compare(t(spark, d, "nation").select(F.col("n_nationkey").alias("run"), F.lit(1).alias("mode"), F.col("n_regionkey").cast("string").alias("signature")))


@query()
def checksum_crc32(spark, d):
    return t(spark, d, "documents").select("doc_id", checksums.crc_text(F.col("text").cast("binary")).alias("crc"))


@query()
def checksum_crc32c(spark, d):
    ship(spark)
    return t(spark, d, "documents").select("doc_id", checksums.crc32c_udf(F.col("text").cast("binary")).alias("crc"))


@query()
def stream_crc(spark, d):
    return checksums.running_crc(t(spark, d, "conversations"), "conv_id", "turn", "text")


@query()
def merkle_blocks(spark, d):
    nodes = t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("oid"), F.col("r_name").alias("own"), F.lit("data").alias("kind")).unionAll(t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.col("n_name"), F.lit("data")))
    edges = t(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return provenance.block_hashes(nodes, edges)


@query("SELECT CAST(c_nationkey AS BIGINT) AS session_id, CAST(count(*) + CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS INTEGER) AS width FROM customer GROUP BY 1")
def max_antichain(spark, d):
    c = t(spark, d, "customer")
    s = F.col("c_nationkey").cast("long").alias("session_id")
    nodes = c.select(s, F.concat(F.lit("c"), "c_custkey").alias("oid")).unionAll(c.select(s, F.lit("root")).distinct())
    edges = c.select(s, F.lit("root").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    return partition.antichains(nodes, edges)


@query()
def edge_zeroing(spark, d):
    c = t(spark, d, "customer")
    s = F.col("c_nationkey").cast("long").alias("session_id")
    nodes = c.select(s, F.concat(F.lit("c"), "c_custkey").alias("oid"), (F.col("c_custkey") % 7 + 1).cast("long").alias("weight")).unionAll(c.select(s, F.lit("root"), F.lit(1).cast("long")).distinct())
    edges = c.select(s, F.lit("root").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), (F.col("c_custkey") % 6).cast("long").alias("weight"))
    return partition.partition(nodes, edges)

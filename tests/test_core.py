"""Invariants that SQL cannot state, small hand-made graphs, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import apps, checksums, scalars
from weftgraph.operators import arrays, gating, graph, lifecycle, provenance, relational
from weftgraph.plans import delayed, partition, prepare, session, unroll
from weftgraph.sources import codecs, stores
from weftgraph.streaming import chunks

TOPOLOGIES = {
    "single": (["a"], []), "two_start": (["a", "b", "c"], [("a", "c"), ("b", "c")]), "two_end": (["a", "b", "c"], [("a", "b"), ("a", "c")]),
    "two_lines": (["a", "b", "c", "d"], [("a", "b"), ("c", "d")]), "fan": (["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("a", "d")]),
    "sandwich": (["a", "b", "c", "d"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]),
}


def frames(spark, name, weight=1):
    ns, es = TOPOLOGIES[name]
    return spark.createDataFrame([(n, weight) for n in ns], "oid string, weight long"), spark.createDataFrame([(a, b, 1) for a, b in es], "src string, dst string, weight long")


@pytest.mark.parametrize("name, roots, leaves, longest", [("single", 1, 1, 1), ("two_start", 2, 1, 3), ("two_end", 1, 2, 3), ("two_lines", 2, 2, 3), ("fan", 1, 3, 3), ("sandwich", 1, 1, 5)])
def test_topologies(spark, name, roots, leaves, longest):
    ns, es = frames(spark, name)
    assert graph.roots(ns, es).count() == roots
    assert graph.leaves(ns, es).count() == leaves
    assert graph.longest_path(ns, es).agg(F.max("length")).first()[0] == longest
    assert graph.levels(ns, es)[1] == 0


def test_cycle_and_path(spark):
    ns = spark.createDataFrame([("a", 1), ("b", 1)], "oid string, weight long")
    es = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, weight long")
    assert graph.levels(ns, es)[1] == 2
    ns, es = frames(spark, "sandwich")
    path, length = graph.longest_path_nodes(ns, es)
    assert length == 5 and path[0] == "a" and path[-1] == "d"


def test_scatter_is_array_split(spark):
    for n, k in ((10, 4), (3, 5), (7, 7), (100, 8)):
        df = spark.range(n)
        got = arrays.scatter(df, k, ["id"]).groupBy("tile").count().collect()
        sizes = {r["tile"]: r["count"] for r in got}
        assert [sizes.get(i, 0) for i in range(k)] == [len(x) for x in np.array_split(np.arange(n), k)]


def test_ranked_strings_and_nulls(spark):
    rows = [(x,) for x in ["b", "a", None, "zz", "Ä", "aa", "b"]]
    got = arrays.ranked(spark.createDataFrame(rows, "s string"), ["s"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(7)) and [r["s"] for r in got] == [None, "a", "aa", "b", "b", "zz", "Ä"]


def test_pick_array(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    head, tail = arrays.pick_array(F.col("a"))
    assert [tuple(r) for r in df.select(head, tail).collect()] == [(1, [2, 3]), (None, [])]


def brute_antichain(n, edges, w):
    reach = partition.closure(n, edges)
    best = 0
    for mask in range(1 << n):
        group = [i for i in range(n) if mask >> i & 1]
        if all(not reach[a] >> b & 1 for a in group for b in group):
            best = max(best, sum(w[i] for i in group))
    return best


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.randoms(use_true_random=False))
def test_antichain(n, rnd):
    edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.3]
    w = [rnd.randint(0, 4) for _ in range(n)]
    assert partition.max_antichain(n, edges, w) == brute_antichain(n, edges, w)


def test_edge_zeroing_chain():
    edges = [(0, 1, 10), (1, 2, 10), (2, 3, 10)]
    assert len(set(partition.zero_edges(4, edges, [5, 0, 5, 0]))) == 1
    rnd = random.Random(1)
    for _ in range(10):
        n = rnd.randint(2, 9)
        edges = [(a, b, rnd.randint(1, 9)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.4]
        w = [rnd.randint(0, 5) for _ in range(n)]
        part = partition.zero_edges(n, edges, w, capacity=2)
        after = [(a, b, 0 if part[a] == part[b] else c) for a, b, c in edges]
        assert partition.longest(n, after, w) <= partition.longest(n, edges, w)


def test_lanes():
    assert partition.lanes([(0, 2), (0, 3), (2, 4)]) == [0, 1, 0]


def test_fill_and_globals(spark):
    given_ = {"beam": 12, "beam_width": "3.5", "band.upper": False, "host": {"name": "n7"}}
    template = "~beam/~{beam_width} ~beam_width ~{band.upper} ~{host.name} ~~beam ~{beam}x"
    assert prepare.fill(template, given_) == "12/3.5 3.5 False n7 ~beam 12x"
    df = spark.createDataFrame([(template,), ("plain",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(prepare.fill_column(F.col("s"), given_)).collect()] == ["12/3.5 3.5 False n7 ~beam 12x", "plain", "", None]
    with pytest.raises(Exception, match="no parameter nope"):
        spark.createDataFrame([("~nope",)], "s string").select(prepare.fill_column(F.col("s"), given_)).collect()
    with pytest.raises(KeyError):
        prepare.fill("~nope", given_)
    g = {"nodeDataArray": [{"id": "g", "category": "GlobalVariables", "fields": [{"name": "n", "type": "Integer", "value": "4"}]}, {"id": "x", "fields": [{"name": "a", "value": "{n}"}, {"name": "b", "value": "k{n}"}]}], "linkDataArray": []}
    out = prepare.substitute_globals(g)
    assert [f["value"] for f in out["nodeDataArray"][0]["fields"]] == [4, "k4"]


def test_unroll_loop_and_groupby(spark):
    n, x = unroll.Node, unroll.Link
    g = unroll.LogicalGraph([n("l", "loop", "Loop", fields={"num_of_iter": 3}), n("a", "app", "PythonApp", "l", start=True), n("d", "data", "File", "l", "data", end=True), n("o", "out", "PythonApp"), n("i", "in", "File", None, "data")], [x("a", "d"), x("d", "a"), x("d", "o", loop_aware=True), x("i", "a", loop_aware=True)])
    nodes, edges = unroll.unroll(spark, g)
    pairs = sorted((r["src"], r["dst"]) for r in edges.collect())
    assert nodes.count() == 8
    assert ("s_d_0-0", "s_a_0-1") in pairs and ("s_d_0-2", "s_o_0") in pairs and ("s_i_0", "s_a_0-0") in pairs and len(pairs) == 3 + 2 + 1 + 1
    g = unroll.LogicalGraph([n("o", "outer", "Scatter", fields={"num_of_copies": 2}), n("i", "inner", "Scatter", "o", fields={"num_of_copies": 3}), n("d", "data", "File", "i", "data"), n("b", "by", "GroupBy"), n("a", "app", "PythonApp", "b")], [x("d", "a")])
    nodes, edges = unroll.unroll(spark, g)
    assert nodes.where("lg_key = 'a'").count() == 3
    assert edges.where("dst = 's_a_0-1'").count() == 2
    with pytest.raises(unroll.GraphError):
        unroll.LogicalGraph([n("s", "", "Scatter"), n("a", "", "App")], [x("s", "a")])


def test_firing(spark):
    df = spark.createDataFrame([("a", 1, "completed", 1), ("a", 2, "error", 2), ("a", 3, "completed", 3)], "app string, input int, status string, ts int")
    assert gating.fire(df, -1, 33, ["ts"]).first()["outcome"] == "run"
    assert gating.fire(df, -1, 32, ["ts"]).first()["outcome"] == "error"
    assert gating.fire(df, 1, 0, ["ts"]).first()["outcome"] == "run"
    for bad in (0, -2):
        with pytest.raises(ValueError):
            gating.effective(df, bad, ["ts"])


def test_session(spark):
    ns, es = frames(spark, "sandwich")
    nodes = ns.select("oid", F.when(F.col("oid").isin("a", "d"), "data").otherwise("app").alias("kind"), F.lit(0).alias("threshold"))
    s = session.SessionManager(spark).create("s1")
    s.add_graph(nodes, es)
    with pytest.raises(session.SessionError):
        s.add_graph(nodes, es)
    assert s.deploy().count() == 1
    out = {r["oid"]: r["status"] for r in s.run(spark.createDataFrame([("a", "completed"), ("b", "error")], "oid string, status string")).collect()}
    assert out == {"a": "completed", "b": "error", "c": "completed", "d": "error"}


def test_provenance(spark):
    ns = spark.createDataFrame([("a", "x", "data"), ("b", "y", "app"), ("c", "z", "app"), ("d", "w", "data")], "oid string, own string, kind string")
    es = spark.createDataFrame(TOPOLOGIES["sandwich"][1], "src string, dst string")
    one = {r["oid"]: r["block"] for r in provenance.block_hashes(ns, es).collect()}
    two = {r["oid"]: r["block"] for r in provenance.block_hashes(ns, es.orderBy(F.desc("src"))).collect()}
    changed = {r["oid"]: r["block"] for r in provenance.block_hashes(ns.withColumn("own", F.when(F.col("oid") == "a", "other").otherwise(F.col("own"))), es).collect()}
    assert one == two and all(one[k] != changed[k] for k in one)
    sig = provenance.signature(provenance.block_hashes(ns, es), es)
    assert len(sig) == 64
    same = {r["oid"]: r["block"] for r in provenance.block_hashes(ns.withColumn("own", F.when(F.col("oid") == "b", "other").otherwise(F.col("own"))), es, reproduce=True).collect()}
    repro = {r["oid"]: r["block"] for r in provenance.block_hashes(ns, es, reproduce=True).collect()}
    assert same["d"] == repro["d"]


def test_checksums(spark):
    assert checksums.crc32c(b"123456789") == 0xE3069283
    assert checksums.crc32c(b"6789", checksums.crc32c(b"12345")) == 0xE3069283
    rnd = random.Random(3)
    values = [None, b"", b"123456789", *(rnd.randbytes(rnd.choice([1, 7, 300])) for _ in range(60)), rnd.randbytes(5000)]
    assert checksums.crc32c_all(values) == [None if v is None else checksums.crc32c(v) for v in values]
    df = spark.createDataFrame([("a", 1, bytearray(b"world")), ("a", 0, bytearray(b"hello "))], "uid string, seq long, chunk binary")
    assert checksums.running_crc(df, "uid", "seq", "chunk").first()["crc"] == zlib.crc32(b"hello world")
    assert bytes(stores.chunks_of(df, "uid", "seq", "chunk").first()["content"]) == b"hello world"


def test_lifecycle(spark):
    data = spark.createDataFrame([("a", "completed", False, True), ("b", "completed", False, True), ("c", "completed", True, True)], "oid string, status string, persist boolean, expire_after_use boolean")
    uses = spark.createDataFrame([("b", True), ("b", False)], "oid string, finished boolean")
    assert [r["oid"] for r in lifecycle.expire_after_use(data, uses).collect()] == ["a"]


def test_relational(spark):
    table = relational.Table(spark, "mega", spark.createDataFrame([("hello", 0), ("hello1", 1)], "a_string string, an_integer int"))
    assert [tuple(r) for r in table.select(condition="an_integer < {}", vals=(1,)).collect()] == [("hello", 0)]
    assert table.insert({"a_string": "x"}).count() == 3 and len(table.log) == 2
    assert relational.rewrite("a = {} and b = {}", "numeric") == "a = :1 and b = :2"


def test_delayed():
    calls = []
    add = delayed.delayed(lambda a, b: calls.append(1) or a + b)
    x = add(1, 2)
    assert delayed.compute([add(x, x), add(x, 1)]) == [6, 4] and len(calls) == 3
    pair = delayed.delayed(lambda v: (v, -v), nout=2)(5)
    a, b = pair
    assert delayed.compute(add(a, b)) == 0


def test_scalars(spark):
    df = spark.createDataFrame([("1", "{\"k\": 3}", "a b\nc"), ("False", "oops", "")], "b string, j string, t string")
    out = df.select(scalars.to_bool(F.col("b")).alias("b"), F.to_json(scalars.string_to_json(F.col("j"))).alias("j"), scalars.read_words(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in out] == [(True, '{"k":3}', ["a", "b", "c"]), (False, "[]", [])]


def test_codecs_and_stores(spark, tmp_path):
    for value, e in ((b"x", "binary"), ("ü", "utf-8"), ([1, 2], "pickle"), ({"a": 1}, "eval"), (b"y", "dataurl")):
        assert codecs.load(codecs.dump(value, e), e) == value
    assert codecs.load(codecs.dump([[1.5]], "npy"), "npy").tolist() == [[1.5]]
    path = stores.write_file(spark.range(3), str(tmp_path / "x.parquet"))
    assert stores.open_source(spark, f"file://{path}").count() == 3 and stores.open_source(spark, "odd://x") is None
    with pytest.raises(FileNotFoundError):
        stores.read_file(spark, str(tmp_path / "none.csv"))
    assert stores.parset({"a": 1, "b": "x"}, "yanda") == b"a=1\nb=x" and stores.directory_size(spark, path) > 0


def test_stream_crc(spark, tmp_path):
    rows = [("a", 1, bytearray(b"b"), True), ("a", 0, bytearray(b"a"), False), ("b", 0, bytearray(b"z"), False)]
    spark.createDataFrame(rows, "uid string, seq long, chunk binary, last boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uid string, seq long, chunk binary, last boolean").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = chunks.running_crc(stream).writeStream.format("memory").queryName("crc").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from crc").collect()] == [("a", 2, zlib.crc32(b"ab"))]


def test_apps(spark, tmp_path):
    def f(a, b=2, *rest, c=3, **more):
        return a, b, rest, c, more

    assert apps.call(f, {"a": 1, "b": None}, {"b": 0, "c": 0, "x": 9, "rest": (5,)}) == (1, 0, (5,), 0, {"x": 9})
    with pytest.raises(TypeError):
        apps.call(f)
    assert apps.lookup("math.sqrt")(4.0) == 2 and apps.lookup("len")([1]) == 1
    assert apps.call(apps.REGISTRY["create_range"].function, {}, {"high": 3}) == [0, 1, 2] and apps.sleep("x") == 0
    df = spark.createDataFrame([("a b",), ("c",)], "value string")
    assert [r["output"] for r in apps.run_command(df, "echo -n {value}", "s", "/").collect()] == ["a b", "c"]
    assert [r[0] for r in df.select(apps.apply_column("builtins.len", "int", "value")).collect()] == [3, 1]


def test_gather_sequence_and_services(spark):
    pairs = spark.createDataFrame([(i, i // 2) for i in range(5)], "src_idx long, dst_idx long")
    assert [r["waits_for"] for r in unroll.sequence_gathers(pairs, 2).orderBy("src_idx").collect()] == [None, None, 0, 0, 1]
    n = unroll.Node
    g = unroll.LogicalGraph([n("s", "svc", "Service"), n("a", "app", "PythonApp"), n("b", "out", "File", None, "data")], [unroll.Link("s", "a"), unroll.Link("a", "b")])
    assert [x.src for x in g.links] == ["a"]
    old = {"nodeDataArray": [{"key": -1, "text": "many", "category": "Scatter"}, {"key": -2, "text": "app", "category": "PythonApp", "group": -1}], "linkDataArray": []}
    g = unroll.LogicalGraph.from_json(prepare.prepared(old))
    assert g.nodes["-2"].parent == "-1" and g.dops(g.nodes["-2"]) == [unroll.DEFAULT_COPIES]


def test_command_line(tmp_path, capsys, spark):
    import json

    from weftgraph.__main__ import main

    graph_ = {"nodeDataArray": [{"id": "x", "name": "a", "category": "PythonApp"}, {"id": "y", "name": "d", "category": "File", "categoryType": "Data"}], "linkDataArray": [{"from": "x", "to": "y"}]}
    path = tmp_path / "g.json"
    path.write_text(json.dumps(graph_).replace('"a"', '"~who"'))
    main(["fill", str(path), "-p", "who=me"])
    assert '"me"' in capsys.readouterr().out
    main(["map", str(path), "h0", "h1"])
    out = json.loads(capsys.readouterr().out)
    assert len(out["nodes"]) == 2 and len(out["edges"]) == 1 and {p["node"] for p in out["parts"]} == {"h1"}

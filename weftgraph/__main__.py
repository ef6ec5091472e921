"""python -m weftgraph fill|unroll|partition|map ...: graphs as JSON, from files to standard output."""

from __future__ import annotations

import argparse
import json


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("weftgraph").getOrCreate()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftgraph")
    sub = parser.add_subparsers(dest="what", required=True)
    fill = sub.add_parser("fill", help="fill the parameters of a logical graph template")
    fill.add_argument("graph")
    fill.add_argument("-p", action="append", default=[], metavar="NAME=VALUE")
    unroll = sub.add_parser("unroll", help="a physical graph template as nodes and edges")
    unroll.add_argument("graph")
    part = sub.add_parser("partition", help="unroll and partition")
    part.add_argument("graph")
    part.add_argument("-a", default="mysarkar")
    part.add_argument("-n", type=int, default=1)
    place = sub.add_parser("map", help="unroll, partition and map to hosts")
    place.add_argument("graph")
    place.add_argument("hosts", nargs="+")
    place.add_argument("-i", type=int, default=1)
    a = parser.parse_args(argv)
    from .plans import partition, prepare
    from .plans.unroll import LogicalGraph
    from .plans.unroll import unroll as expand

    if a.what == "fill":
        with open(a.graph) as f:
            print(prepare.fill(f.read(), dict(x.split("=", 1) for x in a.p)))
        return
    from pyspark.sql import functions as F

    nodes, edges = expand(_spark(), LogicalGraph.from_json(prepare.prepared(a.graph)))
    out = {"nodes": nodes, "edges": edges}
    if a.what != "unroll":
        one = F.lit("s").alias("session_id")
        parts = partition.partition(nodes.select(one, "oid", "weight"), edges.select(one, "src", "dst", F.lit(5).cast("long").alias("weight")), getattr(a, "a", "mysarkar"), parts=getattr(a, "n", 1))
        out["parts"] = partition.map_to_nodes(parts, a.hosts, a.i) if a.what == "map" else parts
    print(json.dumps({k: [json.loads(r) for r in df.toJSON().toLocalIterator()] for k, df in out.items()}))


if __name__ == "__main__":
    main()

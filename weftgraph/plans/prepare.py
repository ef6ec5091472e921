"""Preparing logical graphs: versions, parameters, globals, configurations, sub-graphs."""

from __future__ import annotations

import copy
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .unroll import load

_PARAMETER = re.compile(r"~(?:(~)|\{([A-Za-z_][\w.]*)\}|([A-Za-z_][\w.]*))")
CASTS = {"Integer": int, "Float": float, "String": str, "Boolean": lambda v: str(v) in ("1", "true", "True", "yes")}
SQL_CASTS = {"Integer": "bigint", "Float": "double", "String": "string", "Boolean": "boolean"}


def version(graph: dict) -> str:
    """The declared schema version, else what the links and fields look like."""
    declared = graph.get("modelData", {}).get("schemaVersion")
    if declared:
        return str(declared)
    nodes = graph.get("nodeDataArray", [])
    return "fields" if any("fields" in n for n in nodes) else "legacy"


def flatten(parameters: dict, prefix: str = "") -> dict:
    """Nested dictionaries with dotted names."""
    out = {}
    for k, v in parameters.items():
        if isinstance(v, dict):
            out |= flatten(v, f"{prefix}{k}.")
        out[f"{prefix}{k}"] = v
    return out


def fill(template: str, parameters: dict) -> str:
    """Replace ~name and ~{name}; ~~ is a tilde; an unknown name is a KeyError."""
    flat = flatten(parameters)
    return _PARAMETER.sub(lambda m: "~" if m[1] else str(flat[m[2] or m[3]]), template)


def fill_column(c: Column, parameters: dict) -> Column:
    """fill() over a column; an unknown name fails the query."""
    values = F.create_map(*[F.lit(x) for k, v in flatten(parameters).items() for x in (k, str(v))]) if parameters else F.expr("cast(map() as map<string, string>)")
    # text and names by turns: the parts between names, and the names that follow them
    named = F.transform(F.regexp_extract_all(c, F.lit(f"({_PARAMETER.pattern})"), F.lit(1)), lambda x: F.regexp_replace(x, r"^~\{?|\}$", ""))
    between = F.split(c, _PARAMETER.pattern, -1)
    known = lambda x: F.when((x == "") | (x == "~"), "~").when(F.map_contains_key(values, x), values[x]).otherwise(F.raise_error(F.concat(F.lit("no parameter "), x)))
    return F.array_join(F.zip_with(between, named, lambda t, n: F.concat(t, F.when(n.isNull(), "").otherwise(known(n)))), "")


def fields_of(node: dict) -> dict:
    """Field values by name, the default where a value is empty."""
    return {f["name"]: f.get("value") if f.get("value") not in (None, "") else f.get("defaultValue") for f in node.get("fields", [])}


def substitute_globals(graph: dict) -> dict:
    """Replace {name} in every string field by global variables, cast what becomes whole
    to the declared type, and remove the variables' nodes."""
    graph = copy.deepcopy(load(graph))
    known: dict = {}
    for n in graph["nodeDataArray"]:
        if n.get("category") == "GlobalVariables":
            for f in n.get("fields", []):
                if f.get("type") not in CASTS:
                    raise ValueError(f"global {f['name']} has type {f.get('type')}")
                known[f["name"]] = CASTS[f["type"]](f.get("value"))
    graph["nodeDataArray"] = [n for n in graph["nodeDataArray"] if n.get("category") != "GlobalVariables"]
    for n in graph["nodeDataArray"]:
        for f in n.get("fields", []):
            v = f.get("value")
            if isinstance(v, str):
                whole = re.fullmatch(r"\{(\w+)\}", v)
                f["value"] = known[whole[1]] if whole and whole[1] in known else re.sub(r"\{(\w+)\}", lambda m: str(known.get(m[1], m[0])), v)
    return graph


def global_column(c: Column, values: dict[str, tuple[str, str]]) -> Column:
    """{name} in a column replaced; values: name -> (type, text)."""
    for name, (kind, text) in values.items():
        if kind not in SQL_CASTS:
            raise ValueError(f"global {name} has type {kind}")
        c = F.replace(c, F.lit("{" + name + "}"), F.lit(text))
    return c


def overlay(fields: DataFrame, configuration: DataFrame, keys: tuple = ("node", "field"), value: str = "value") -> DataFrame:
    """Field values with those of a configuration in their place where it has one."""
    cfg = configuration.select(*keys, F.col(value).alias("_cfg"))
    return fields.join(cfg, list(keys), "left").withColumn(value, F.coalesce("_cfg", value)).drop("_cfg")


def unknown_nodes(fields: DataFrame, configuration: DataFrame, key: str = "node") -> DataFrame:
    """Configuration rows whose node is not in the graph (a warning, no failure)."""
    return configuration.join(fields.select(key).distinct(), key, "left_anti")


def apply_configuration(graph: dict, name: str | None = None) -> dict:
    """The graph with its active (or the named) configuration's values."""
    graph = copy.deepcopy(load(graph))
    all_of = graph.get("graphConfigurations") or {}
    chosen = all_of.get(graph.get("activeGraphConfigId")) if name is None else next((c for c in all_of.values() if c.get("modelData", {}).get("name", c.get("name")) == name), None)
    if name is not None and chosen is None:
        raise KeyError(name)
    for node_id, node_cfg in ((chosen or {}).get("nodes") or {}).items():
        for n in graph["nodeDataArray"]:
            if str(n["id"]) == node_id:
                for f in n.get("fields", []):
                    own = node_cfg.get("fields", {}).get(f.get("id", f["name"]))
                    if own is not None:
                        f["value"] = own.get("value")
    return graph


def split_subgraphs(graph: dict) -> dict:
    """Cut each SubGraph's children and their links out into a graph of its own, kept in the
    construct's field `graph`; what remains runs it as one application."""
    graph = copy.deepcopy(load(graph))
    for sub in [n for n in graph["nodeDataArray"] if n.get("category") == "SubGraph"]:
        inside, grew = {sub["id"]}, True
        while grew:
            more = {n["id"] for n in graph["nodeDataArray"] if n.get("parentId") in inside} - inside
            inside |= more
            grew = bool(more)
        inside.discard(sub["id"])
        children = [n for n in graph["nodeDataArray"] if n["id"] in inside]
        links = [x for x in graph["linkDataArray"] if x["from"] in inside and x["to"] in inside]
        for n in children:
            if n.get("parentId") == sub["id"]:
                n["parentId"] = None
        sub.setdefault("fields", []).append({"name": "graph", "value": {"modelData": graph.get("modelData", {}), "nodeDataArray": children, "linkDataArray": links}})
        graph["nodeDataArray"] = [n for n in graph["nodeDataArray"] if n["id"] not in inside]
        graph["linkDataArray"] = [x for x in graph["linkDataArray"] if x["from"] not in inside and x["to"] not in inside]
    return graph


def convert_legacy(graph: dict) -> dict:
    """An old graph (key, group, isGroup) with the names of the current format."""
    graph = copy.deepcopy(load(graph))
    for n in graph["nodeDataArray"]:
        if "key" in n:
            n["id"] = str(n.pop("key"))
        if "group" in n:
            n["parentId"] = str(n.pop("group"))
        if "text" in n:
            n.setdefault("name", n.pop("text"))
    for x in graph["linkDataArray"]:
        x["from"], x["to"] = str(x["from"]), str(x["to"])
    return graph


def prepared(source, configuration: str | None = None) -> dict:
    """A logical graph ready to be unrolled: an old one converted, its configuration and
    global variables put in, and sub-graphs cut out."""
    graph = load(source)
    if version(graph) == "legacy":
        graph = convert_legacy(graph)
    return split_subgraphs(substitute_globals(apply_configuration(graph, configuration)))


def bind_parameters(command: str, physical: dict[str, str]) -> str:
    """Logical ids %i[id] and %o[id] of a command replaced by physical ones."""
    return re.sub(r"%([io])\[([^\]]+)\]", lambda m: f"%{m[1]}[{physical.get(m[2], m[2])}]", command)

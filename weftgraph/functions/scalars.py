"""Scalar functions on names, paths, values and JSON, as Columns."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a file name does not take.
ILLEGAL = r"[^A-Za-z0-9._-]"


def placeholders(c: Column) -> Column:
    """Names of the {x} in a path."""
    return F.regexp_extract_all(c, F.lit(r"\{(\w+)\}"), F.lit(1))


def fill_path(c: Column, values: dict[str, Column]) -> Column:
    for name, v in values.items():
        c = F.replace(c, F.lit("{" + name + "}"), v)
    return c


def base_name(uid: Column, human: Column) -> Column:
    """The uid up to its first _, then _ and the human key, without illegal characters."""
    return F.regexp_replace(F.concat(F.split_part(uid, F.lit("_"), F.lit(1)), F.lit("_"), human), ILLEGAL, "_")


def short_key(uid: Column, n: int = 6) -> Column:
    """The first n characters of each part of a uid."""
    return F.array_join(F.transform(F.split(uid, "_"), lambda p: F.substring(p, 1, n)), "_")


def join_path(folder: Column, name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), name))


def expand(path: str) -> str:
    """Environment variables in a path; an unset one is a KeyError."""
    return re.sub(r"\$(?:\{(\w+)\}|(\w+))", lambda m: os.environ[m[1] or m[2]], path)


def escape_quotes(c: Column, single: bool = True, double: bool = True) -> Column:
    if single:
        c = F.replace(c, F.lit("'"), F.lit("\\'"))
    if double:
        c = F.replace(c, F.lit('"'), F.lit('\\"'))
    return c


def to_bool(c: Column) -> Column:
    """1, true, True and yes are true, all else false."""
    return F.coalesce(c.cast("string").isin("1", "true", "True", "yes"), F.lit(False))


def typed(c: Column, kind: str) -> Column:
    """A payload's value by its type name; what does not parse is null."""
    return {
        "int": lambda: c.try_cast("bigint"), "integer": lambda: c.try_cast("bigint"), "float": lambda: c.try_cast("double"),
        "bool": lambda: c.try_cast("boolean"), "boolean": lambda: c.try_cast("boolean"), "json": lambda: F.try_parse_json(c), "raw": lambda: c.cast("binary"),
    }.get(kind, lambda: c.cast("string"))()


def mode_of(c: Column, default: int = 0) -> Column:
    """A reproducibility mode from text or number, the default where it is none."""
    v = c.try_cast("int")
    return F.when(v.isin(-1, 0, 1, 2, 4, 5, 6, 7, 8, 9), v).otherwise(F.lit(default))


def read_words(c: Column) -> Column:
    """The pieces between white space, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def string_to_json(c: Column) -> Column:
    """Parsed JSON; invalid text is an empty list, empty text stays empty."""
    return F.when(c == "", F.parse_json(F.lit('""'))).otherwise(F.coalesce(F.try_parse_json(c), F.parse_json(F.lit("[]"))))


def greatest_of(a: Column, b: Column) -> Column:
    """The larger of two values, null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def argument(port: Column, given: Column, default: Column) -> Column:
    """A port's value over an argument over a default; empty text on a port is no value."""
    return F.coalesce(F.nullif(port, F.lit("")), given, default)


def yanda(params: Column) -> Column:
    """k=v lines of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")


def ini(params: Column, section: str = "DEFAULT") -> Column:
    return F.concat(F.lit(f"[{section}]\n"), F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), "\n"))


def hello(who: Column | None = None) -> Column:
    return F.lit("Hello World") if who is None else F.concat(F.lit("Hello, "), who)

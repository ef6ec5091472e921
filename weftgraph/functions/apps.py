"""Application surfaces: functions by name, argument precedence, commands, descriptors."""

from __future__ import annotations

import importlib
import inspect
import shlex
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import ship


@dataclass(frozen=True)
class Port:
    name: str
    encoding: str = "pickle"
    stream: bool = False


@dataclass(frozen=True)
class Component:
    """What an operator takes and gives."""

    name: str
    function: Callable
    inputs: tuple[Port, ...] = ()
    outputs: tuple[Port, ...] = ()


REGISTRY: dict[str, Component] = {}


def component(name: str, inputs: tuple = (), outputs: tuple = ()):
    """Register a function as a component."""

    def add(f):
        REGISTRY[name] = Component(name, f, tuple(inputs), tuple(outputs))
        return f

    return add


def lookup(name: str) -> Callable:
    """A function by dotted name: a module's, a class's, or a built-in."""
    parts = name.split(".")
    for i in range(len(parts) - 1, 0, -1):
        try:
            at = importlib.import_module(".".join(parts[:i]))
        except ModuleNotFoundError:
            continue
        for p in parts[i:]:
            at = getattr(at, p)
        return at
    import builtins

    return getattr(builtins, name)


def bind(f: Callable, ports: dict | None = None, arguments: dict | None = None) -> tuple[list, dict]:
    """Positional and keyword arguments of a call: a port's value over an application
    argument over the function's default; None on a port counts as skipped."""
    given = {**(arguments or {}), **{k: v for k, v in (ports or {}).items() if v is not None}}
    args, kwargs = [], {}
    for name, p in inspect.signature(f).parameters.items():
        if p.kind is p.VAR_POSITIONAL:
            args += list(given.pop(name, ()))
        elif p.kind is p.VAR_KEYWORD:
            kwargs.update(given)
        elif name in given:
            if p.kind is p.KEYWORD_ONLY:
                kwargs[name] = given.pop(name)
            else:
                args.append(given.pop(name))
        elif p.default is p.empty:
            raise TypeError(f"no value for {name}")
        elif p.kind is p.KEYWORD_ONLY:
            kwargs[name] = p.default
        else:
            args.append(p.default)
    return args, kwargs


def call(f: Callable | str, ports: dict | None = None, arguments: dict | None = None):
    """Call a function, or one by name; every output gets the whole result."""
    f = lookup(f) if isinstance(f, str) else f
    args, kwargs = bind(f, ports, arguments)
    return f(*args, **kwargs)


def apply_column(f: Callable | str, returns, *cols: Column | str) -> Column:
    """A function of plain values over columns, in Arrow batches."""
    own = lookup(f) if isinstance(f, str) else f

    def each(*parts: pd.Series) -> pd.Series:
        return pd.Series([own(*row) for row in zip(*parts)])

    return F.pandas_udf(each, returns)(*cols)


def command(template: str, ports: dict[str, str]) -> str:
    """A command with {port} or {uid} placeholders filled by quoted values."""
    for name, value in ports.items():
        template = template.replace("{" + name + "}", shlex.quote(str(value)))
    return template


def run_command(df: DataFrame, template: str, session: str, root: str, column: str = "value") -> DataFrame:
    """(value, output) of a command run for each row, batch by batch, with the row's value
    as {value}; a non-zero exit fails the task."""
    ship(df.sparkSession)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for pdf in it:
            out = []
            for v in pdf["value"]:
                done = subprocess.run(command(template, {"value": v}), shell=True, capture_output=True, text=True, env={**os.environ, "WEFT_SESSION_ID": session, "WEFT_ROOT": root, "WEFT_UID": str(v)})  # noqa: S602
                if done.returncode:
                    raise RuntimeError(f"exit {done.returncode}: {done.stderr[-500:]}")
                out.append(done.stdout)
            yield pd.DataFrame({"value": pdf["value"], "output": out})

    return df.select(F.col(column).cast("string").alias("value")).mapInPandas(work, "value string, output string")


@component("create_range", outputs=(Port("range"),))
def create_range(low: int = 0, high: int = 1, step: int = 1) -> list[int]:
    return list(range(low, high, step))


@component("create_multi_out", outputs=(Port("a"), Port("b")))
def create_multi_out(a, b):
    return a, b


@component("get_max", inputs=(Port("a"), Port("b")))
def get_max(a, b):
    return max(a, b)


@component("sleep")
def sleep(seconds=0) -> float:
    """Waits; what is no number waits not at all."""
    import time

    try:
        s = float(seconds)
    except (TypeError, ValueError):
        s = 0.0
    time.sleep(s)
    return s


@component("simple_branch")
def simple_branch(result: bool = True) -> bool:
    return bool(result)

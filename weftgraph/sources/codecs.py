"""Port encodings: pickle, npy, binary, utf-8, eval, dataurl, path."""

from __future__ import annotations

import ast
import base64
import io
import pickle

import numpy as np

#: Names and values are both accepted.
ENCODINGS = ("pickle", "npy", "binary", "utf-8", "raw", "eval", "dataurl", "path")


def _name(encoding: str) -> str:
    e = encoding.lower().replace("_", "-")
    e = {"utf8": "utf-8", "bytes": "binary"}.get(e, e)
    if e not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}")
    return e


def dump(value, encoding: str = "pickle") -> bytes:
    e = _name(encoding)
    if e == "pickle":
        return pickle.dumps(value)
    if e == "npy":
        out = io.BytesIO()
        np.save(out, np.asarray(value), allow_pickle=False)
        return out.getvalue()
    if e in ("utf-8", "path"):
        return str(value).encode()
    if e == "eval":
        return repr(value).encode()
    if e == "dataurl":
        return b"data:;base64," + base64.b64encode(value)
    return bytes(value)


def load(data: bytes, encoding: str = "pickle"):
    e = _name(encoding)
    if e == "pickle":
        return pickle.loads(data)  # noqa: S301
    if e == "npy":
        return np.load(io.BytesIO(data), allow_pickle=False)
    if e in ("utf-8", "path"):
        return data.decode()
    if e == "eval":
        return ast.literal_eval(data.decode())
    if e == "dataurl":
        return base64.b64decode(data.partition(b",")[2])
    return data

"""Binary files in the shared folder, written so that a retried task does no harm."""

from __future__ import annotations

import uuid


def open_fs(uri: str):
    """The file system of a folder's URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_whole(folder: str, name: str, data: bytes) -> str:
    """Write a file under a temporary name, then move it to its own: readers see all of
    it or nothing, and of two attempts the later replaces the earlier."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    hidden = f"{path}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as out:
        out.write(data)
    try:
        fs.move(hidden, f"{path}/{name}")
    except OSError:  # stores that do not rename over a file
        fs.delete_file(f"{path}/{name}")
        fs.move(hidden, f"{path}/{name}")
    return f"{folder}/{name}"


def read_whole(folder: str, name: str) -> bytes:
    fs, path = open_fs(folder)
    with fs.open_input_stream(f"{path}/{name}") as f:
        return f.read()

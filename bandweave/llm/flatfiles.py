"""Flat binary files in the shared folder: written once by tasks, read by range or memory-mapped."""

from __future__ import annotations

import mmap
import os
import re
import sys
import tempfile
import uuid

import numpy as np
from pyarrow import fs

UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI or an absolute path."""
    if path.startswith("file:"):
        path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def write_flat(folder: str, arrays: list[np.ndarray]) -> str:
    """The arrays' bytes one after the other in a new file; a repeated task writes another file and the
    unused one is never named by a committed manifest."""
    path = f"{folder}/{uuid.uuid4().hex}.bin"
    system, plain = store(path)
    system.create_dir(os.path.dirname(plain), recursive=True)
    with system.open_output_stream(plain) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).data)
    return path


def read_range(path: str, start: int, size: int) -> bytes:
    system, plain = store(path)
    with system.open_input_file(plain) as file:
        return file.read_at(size, start)


def mapped_local(path: str) -> np.ndarray:
    if not os.path.getsize(path):
        return np.zeros(0, np.uint8)
    with open(path, "rb") as file:
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED), np.uint8)


def mapped(path: str) -> np.ndarray:
    """The file's bytes, memory-mapped; no file stays open (from Python 3.13 on). A file of a remote store is copied to the
    worker's temporary folder first and unlinked once mapped, so nothing stays behind."""
    system, plain = store(path)
    if isinstance(system, fs.LocalFileSystem):
        return mapped_local(plain)
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(plain) as source:
        while chunk := source.read(8 << 20):
            copy.write(chunk)
        copy.flush()
        return mapped_local(copy.name)


def columns(raw: np.ndarray, count: int, kinds: list[type]) -> list[np.ndarray]:
    """Typed views of ``count`` values of each kind, in file order."""
    out, at = [], 0
    for kind in kinds:
        size = count * np.dtype(kind).itemsize
        out.append(raw[at:at + size].view(kind))
        at += size
    return out

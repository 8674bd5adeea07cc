"""Byte ranges of files in any file system that Arrow opens (local paths, file://, hdfs://, s3:// ...)."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyarrow import fs


def open_file(path: str):
    system, inner = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return system.open_input_file(inner)


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    with open_file(path) as f:
        f.seek(start)
        return f.read(size)


def file_size(path: str) -> int:
    with open_file(path) as f:
        return f.size()


def list_files(folder: str) -> list[str]:
    system, inner = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
    prefix = folder.split("://")[0] + "://" if "://" in folder else ""
    return sorted(prefix + x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.is_file)


def _new_file(path: str):
    system, inner = fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


def write_bytes(path: str, data: bytes) -> None:
    """A whole new file; folders above it are made."""
    with _new_file(path) as f:
        f.write(data)


def join_files(path: str, head: bytes, parts: Iterable[str]) -> None:
    """A new file of ``head`` and what other files hold, in their order, 8 MB at a time."""
    with _new_file(path) as f:
        f.write(head)
        for part in parts:
            with open_file(part) as g:
                while block := g.read(8 << 20):
                    f.write(block)


def read_lines(path: str, start: int, stop: int, first: int, end: int) -> list[bytes]:
    """The lines that begin from ``start`` to before ``stop``, in a part of the file from ``first`` to ``end``."""
    raw, at = read_bytes(path, start, stop - start), stop
    if start > first and read_bytes(path, start - 1, 1) != b"\n":
        _, newline, raw = raw.partition(b"\n")
        if not newline:
            return []  # the middle of a line
    while raw and at < end and not raw.endswith(b"\n"):
        more, newline, _ = read_bytes(path, at, min(1 << 16, end - at)).partition(b"\n")
        raw, at = raw + more + newline, at + len(more) + len(newline)
    return raw.splitlines()

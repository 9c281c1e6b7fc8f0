"""Whole files and byte ranges on the storage that executors share, by path or URI."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


@contextmanager
def new_file(uri: str) -> Iterator:
    """A stream to a file that appears under its name only when it is complete.

    A repeated or doubled task writes its own copy and replaces the file by equal bytes.
    """
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, path)


@contextmanager
def open_ranges(uri: str) -> Iterator:
    """A file for `read_at(length, offset)` and `size()`."""
    system, path = _open(uri)
    with system.open_input_file(path) as file:
        yield file

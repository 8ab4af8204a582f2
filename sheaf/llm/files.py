"""Files that executors write and read by URI, on any file system pyarrow knows (file, hdfs, s3, gs)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow.fs as fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, suffix: str) -> Iterator[tuple[str, object]]:
    """The URI and stream of a new file with a name of its own, so that attempts of one task never meet; readers know files by a manifest."""
    uri = f"{folder}/{uuid4().hex}{suffix}"
    store, path = located(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        yield uri, out


def put_file(folder: str, name: str, write) -> None:
    """Writes ``folder/name`` so that it is there whole or not at all; a task that runs again puts the same file in its place.

    Spark's readers pass over the folder in which it grows.
    """
    store, path = located(folder)
    store.create_dir(f"{path}/_growing", recursive=True)
    growing = f"{path}/_growing/{uuid4().hex}"
    with store.open_output_stream(growing) as out:
        write(out)
    store.move(growing, f"{path}/{name}")

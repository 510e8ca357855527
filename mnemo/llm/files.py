"""Files in the shared folder, written and read by tasks through their URI."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def replacing(uri: str):
    """An output stream whose file appears under its name only when complete, so a task can be retried."""
    system, path = locate(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with system.open_output_stream(partial) as out:
        yield out
    system.move(partial, path)


@contextmanager
def reading(uri: str):
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        yield f

"""Binary files in the shared folder, written and read inside tasks.

A task writes under a name of its own and reports it when the file is complete; only reported files count. A task that
runs twice leaves a file that nobody reads, so lost executors and repeated attempts do no harm.
"""

from __future__ import annotations

from uuid import uuid4

import pyarrow.fs as pafs
from pyspark import TaskContext


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> tuple[str, object]:
    """(uri, stream) of a new file whose name begins with the number of the task's partition."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    name = f"part-{part:06d}-{uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(uri: str) -> object:
    """A stream of the file that can seek."""
    system, path = _open(uri)
    return system.open_input_file(path)


def partition() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0

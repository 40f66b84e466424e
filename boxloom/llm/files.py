"""Binary files that executors write to and read from the shared folder, on any store that pyarrow knows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext


def store_of(path: str):
    filesystem, inner = pafs.FileSystem.from_uri(path)
    return filesystem, inner


def make_folder(path: str) -> None:
    filesystem, inner = store_of(path)
    filesystem.create_dir(inner, recursive=True)


def task_file(folder: str, suffix: str) -> str:
    """A name of its own for each task attempt: a task that runs again, or twice, never writes into another's file,
    and only files named by tasks that ended well are ever read."""
    return f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"


@contextmanager
def writing(path: str):
    filesystem, inner = store_of(path)
    with filesystem.open_output_stream(inner, compression=None) as out:
        yield out


@contextmanager
def reading(path: str):
    filesystem, inner = store_of(path)
    local = isinstance(filesystem, pafs.LocalFileSystem)
    with pa.memory_map(inner) if local else filesystem.open_input_file(inner) as source:
        yield source

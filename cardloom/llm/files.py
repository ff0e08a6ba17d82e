"""Files in a folder that driver and executors share, by URI, with writes that a repeated task can redo."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def write(uri: str, data: bytes) -> None:
    """All or nothing: a task that is run again, or twice, leaves one whole file."""
    where, path = _at(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with where.open_output_stream(part) as out:
        out.write(data)
    where.move(part, path)


def read(uri: str) -> bytes:
    where, path = _at(uri)
    with where.open_input_stream(path) as source:
        return source.read()


def read_range(uri: str, start: int, length: int) -> bytes:
    where, path = _at(uri)
    with where.open_input_file(path) as source:
        source.seek(start)
        return source.read(length)


def file_size(uri: str) -> int:
    where, path = _at(uri)
    return where.get_file_info(path).size

"""Byte streams by URI, from executors: local and mounted paths, and whatever else pyarrow can open."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return uri if not parts.scheme else unquote(parts.path) if parts.scheme == "file" else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str) -> Iterator[BinaryIO]:
    """A new file at uri, there only once it is whole."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as out:
                yield out
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.unlink(part)
    else:
        system, path = _remote(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            yield out


@contextmanager
def reading(uri: str) -> Iterator[BinaryIO]:
    """A seekable stream."""
    if path := _local(uri):
        with open(path, "rb") as stream:
            yield stream
    else:
        system, path = _remote(uri)
        with system.open_input_file(path) as stream:
            yield stream

"""Files in the shared folder: plain ones for file:, any other scheme through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse


def _local(uri: str) -> str | None:
    p = urlparse(uri)
    return p.path if p.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A binary file to write, which appears under its own name only when the block ends without an error."""
    temporary = f"{uri}.{uuid.uuid4().hex}.tmp"
    if (path := _local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        hidden = _local(temporary)
        try:
            with open(hidden, "wb") as f:
                yield f
            os.replace(hidden, path)
        finally:
            if os.path.exists(hidden):
                os.remove(hidden)
    else:
        system, path = _remote(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        hidden = f"{path}{temporary[len(uri) :]}"
        with system.open_output_stream(hidden) as f:
            yield f
        system.move(hidden, path)


@contextmanager
def opened(uri: str):
    """A binary file to read, with seek()."""
    if (path := _local(uri)) is not None:
        with open(path, "rb") as f:
            yield f
    else:
        system, path = _remote(uri)
        with system.open_input_file(path) as f:
            yield f

"""Files in the shared folder, from executors: any store that pyarrow's file systems reach."""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    if re.match(r"file:/(?!//)", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def attempt_name(stem: str) -> str:
    """A name of its own for each attempt of a task: a second attempt never writes over the first."""
    return f"{stem}-{uuid.uuid4().hex[:12]}"


def mapped(uri: str, dtype: str) -> np.ndarray:
    """The whole file as an array; memory-mapped where it is local."""
    system, path = locate(uri)
    if isinstance(system, fs.LocalFileSystem):
        if system.get_file_info(path).size == 0:
            return np.zeros(0, dtype)
        return np.memmap(path, dtype, "r")
    with system.open_input_file(uri if path is None else path) as f:
        return np.frombuffer(f.read(), dtype)

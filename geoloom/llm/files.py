"""Binary files in a shared folder, by URI, from the driver and from executors."""

from __future__ import annotations

import os
from typing import Any

import numpy as np


def at(uri: str) -> tuple[Any, str]:
    """The file system and the path on it that a URI names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = at(uri)
    system.create_dir(path, recursive=True)


def remove_folder(uri: str) -> None:
    """Remove a folder with what is in it, where there is one."""
    from pyarrow import fs

    system, path = at(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def create(uri: str) -> Any:
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def mapped(uri: str) -> np.ndarray:
    """The file's bytes: memory-mapped where the file system is mounted, read elsewhere."""
    system, path = at(uri)
    if system.type_name == "local":
        return np.asarray(np.memmap(path, np.uint8, "r")) if os.path.getsize(path) else np.zeros(0, np.uint8)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


class Ranges:
    """Byte ranges of a file: views of the mapped file where its system is mounted, else read in blocks of BLOCK bytes or more."""

    BLOCK = 8 << 20

    def __init__(self, uri: str):
        system, path = at(uri)
        self.whole = mapped(uri) if system.type_name == "local" else None
        self.file = None if self.whole is not None else system.open_input_file(path)
        self.first, self.held = 0, np.zeros(0, np.uint8)

    def read(self, offset: int, n: int) -> np.ndarray:
        if self.whole is not None:
            return self.whole[offset : offset + n]
        if offset < self.first or offset + n > self.first + len(self.held):
            self.first, self.held = offset, np.frombuffer(self.file.read_at(max(n, self.BLOCK), offset), np.uint8)
        return self.held[offset - self.first : offset - self.first + n]

"""Files in the shared folder, opened by executors and by nobody's local disk rules: any URI that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (or absolute path) and the path in it."""
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """A new file, open for writing; its folder is made where needed."""
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # as the name would otherwise decide


def open_file(uri: str):
    """A file, open for reading at any place."""
    system, path = at(uri)
    return system.open_input_file(path)

"""Files in the shared folder, opened by executors through pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = at(uri)
    system.create_dir(path, recursive=True)


def writer(uri: str):
    system, path = at(uri)
    return system.open_output_stream(path)


def reader(uri: str):
    """A random-access file."""
    system, path = at(uri)
    return system.open_input_file(path)

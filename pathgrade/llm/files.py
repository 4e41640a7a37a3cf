"""Byte streams in the shared folder, for formats that Spark has no writer for.

A task writes under a name of its own and returns it; only names that come back in a committed manifest are read, so
a lost executor or a second attempt leaves at most an unread file. Shared folders need a scheme pyarrow knows.
"""

from __future__ import annotations

import pyarrow.fs as pafs


def open_out(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def open_in(uri: str):
    """A random-access file; read_at() fetches one byte range."""
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    return fs.open_input_file(path)


def size_of(uri: str) -> int:
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    return fs.get_file_info(path).size

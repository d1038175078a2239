"""Paths of shared folders for code that reads or writes bytes in tasks."""

from __future__ import annotations

import pyarrow.fs


def open_path(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """pyarrow's file system and the path in it: local files, or HDFS, S3 and GCS by URI."""
    if "://" not in uri and not uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)

"""File systems of paths."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path (local ones, or with the scheme file, hdfs, s3 or gs), and the path in it."""
    if ":" not in path.partition("/")[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))

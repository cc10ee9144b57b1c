"""Files for data sources that read them themselves, through pyarrow."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def opened(location: str):
    """The file system of a location and the path in it."""
    import pyarrow.fs as pafs

    if location.startswith("file:/") and not location.startswith("file://"):
        location = location.removeprefix("file:")
    return pafs.FileSystem.from_uri(location)


def listed(location: str, recursive: bool = False):
    """The file system, and what lies in a folder in order of paths; hidden names are left out."""
    import pyarrow.fs as pafs

    fs, path = opened(location)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return fs, [info]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=recursive))
    below = len(path.rstrip("/")) + 1
    shown = [i for i in found if not any(part.startswith(("_", ".")) for part in i.path[below:].split("/"))]
    return fs, sorted(shown, key=lambda i: i.path)


def carried(*modules: str) -> None:
    """Send the code of these modules with the tasks, so that workers import nothing of ours."""
    for name in (__name__, *modules):
        cloudpickle.register_pickle_by_value(sys.modules[name])

"""Binary files that tasks write to, and read from, the shared scratch folder.

Spark's committer does not cover such files. So each attempt of a task writes under a name
of its own, and only the table of names that Spark commits says which files count; what
a lost attempt left behind is never read.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it. Hadoop writes local files as file:/path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def attempt_file(folder: str, prefix: str, suffix: str) -> str:
    return f"{folder}/{prefix}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """An output stream, with the folder made if need be."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # by default a suffix such as .zst would compress once more


def open_input(uri: str):
    """A seekable input."""
    system, path = locate(uri)
    return system.open_input_file(path)

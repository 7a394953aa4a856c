"""Files that tasks write to and read from the shared folder, by any path that pyarrow knows."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


@contextmanager
def writing(path: str):
    """A file that appears under its name when it is whole; a task that runs again replaces it."""
    files, place = located(path)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as out:
        yield out
    files.move(part, place)


def reading(path: str):
    files, place = located(path)
    return files.open_input_file(place)

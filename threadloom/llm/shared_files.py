"""Files that tasks write to the folder all executors share, through the filesystem its URI names."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole: under a name of this attempt's own first, then moved, so that a lost or repeated attempt of a
    task leaves one file with the same bytes. Names that begin with an underscore are not part of a folder's content."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/_{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")


def listing(folder: str) -> list[tuple[str, int]]:
    """(path, size) of a folder's files, sorted; none if there is no such folder."""
    store, path = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0

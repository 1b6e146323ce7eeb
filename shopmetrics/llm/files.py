"""Files that tasks write to the shared folder: under a temporary name first, then renamed."""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder given as a path or as a URI (file, hdfs, s3, gs ...)."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Committed:
    """A file that gets its name when it is complete. A task that runs again replaces it by the same bytes; what a
    lost task leaves has a temporary name and is not read."""

    def __init__(self, folder: str, name: str):
        self.fs, path = located(folder)
        self.path = f"{path}/{name}"
        self.temporary = f"{path}/_temporary-{uuid.uuid4().hex}-{name}"
        self.fs.create_dir(path, recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> int:
        self.stream.close()
        self.fs.move(self.temporary, self.path)
        return self.size

"""Files that tasks write to and read from the shared folder, through pyarrow's file systems.

Paths are URIs by the time they get here: `common.shared_folder` gives a path without a scheme that of Spark's default file
system.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class AtomicFile:
    """A file that appears under its name only when it is complete, so an attempt that dies leaves nothing to read.

    Two attempts of one task write the same bytes; the last to finish replaces the first.
    """

    def __init__(self, folder: str, name: str) -> None:
        self.system, base = locate(folder)
        self.system.create_dir(base, recursive=True)
        self.path, self.draft = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.draft, self.path)

    def __enter__(self) -> AtomicFile:
        return self

    def __exit__(self, kind: object, *_: object) -> None:
        if kind is None:
            self.close()
        else:
            self.stream.close()
            self.system.delete_file(self.draft)


def open_input(folder: str, name: str):  # noqa: ANN201
    system, base = locate(folder)
    return system.open_input_file(f"{base}/{name}")

"""Directory-walk source (SRC-1): a Python data source that prunes before it descends.

Planning lists folders level by level from the root until there are enough of them, and each becomes an input
partition, beside one for files met on the way; a partition walks the rest of its folders itself. A folder whose name starts with
a pruned prefix is never listed, and none of its files is opened. A file is read inside a try: what cannot be opened or
read gives a row with null content, as one unreadable file must not end a scan of millions.

Options: ``path``; ``suffixes`` and ``prune`` (comma-separated, any of them; none: all files, no pruning); ``content`` (false:
list only); ``partitions`` (folders to plan with). Links to folders are not followed.
"""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, relpath string, length long, content binary, text string"
PARTITIONS = 64
BATCH_BYTES = 8 << 20
#: schemes whose files this source opens by itself; others are left to Spark's readers
SCHEMES = ("file", "hdfs", "s3", "gs")


def opens(path: str) -> bool:
    return "://" not in path and not path.startswith("file:") or path.split(":", 1)[0] in SCHEMES


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


class Part(InputPartition):
    def __init__(self, folders: list[str], files: list[tuple[str, int | None]]):
        super().__init__(None)
        self.folders, self.files = folders, files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        split = lambda key: tuple(x for x in options.get(key, "").split(",") if x)
        self.path, self.suffixes, self.prune = options["path"], split("suffixes"), split("prune")
        self.content = options.get("content", "true").lower() != "false"
        self.wanted = max(1, int(options.get("partitions", PARTITIONS)))

    def _list(self, fs, folder: str) -> tuple[list[str], list[tuple[str, int | None]]]:
        """Folders to descend into and files to take; a folder that cannot be listed has neither."""
        folders, files = [], []
        try:
            found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        except OSError:
            return folders, files
        local = isinstance(fs, pafs.LocalFileSystem)
        for x in sorted(found, key=lambda x: x.path):
            if x.type == pafs.FileType.Directory:
                if not x.base_name.startswith(self.prune or ("\0",)) and not (local and os.path.islink(x.path)):
                    folders.append(x.path)
            elif not self.suffixes or x.base_name.endswith(self.suffixes):
                files.append((x.path, x.size if x.type == pafs.FileType.File else None))
        return folders, files

    def partitions(self):
        fs, root = file_system(self.path)
        frontier, files = [root.rstrip("/") or "/"], []
        while frontier and len(frontier) < self.wanted:
            below = []
            for folder in frontier:
                more, own = self._list(fs, folder)
                below += more
                files += own
            frontier = below
        step = -(-len(frontier) // (4 * self.wanted)) or 1
        parts = [Part(frontier[k:k + step], []) for k in range(0, len(frontier), step)]
        step = -(-len(files) // self.wanted) or 1
        return parts + [Part([], files[k:k + step]) for k in range(0, len(files), step)] or [Part([], [])]

    def read(self, partition):
        fs, root = file_system(self.path)
        held, size = [], 0
        for path, length in self._files(fs, partition):
            content = self._read(fs, path) if self.content else None
            held.append((path, path[len(root.rstrip("/")) + 1:], len(content) if content is not None else length, content, _text(content)))
            size += len(content or b"") + 200
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _files(self, fs, partition):
        yield from partition.files
        todo = list(reversed(partition.folders))
        while todo:
            folders, files = self._list(fs, todo.pop())
            yield from files
            todo += reversed(folders)

    def _read(self, fs, path: str) -> bytes | None:
        try:
            with fs.open_input_stream(path, compression=None) as f:
                return f.read()
        except (OSError, pa.ArrowException):
            return None


def _text(content: bytes | None) -> str | None:
    try:
        return None if content is None else content.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["path", "relpath", "length", "content", "text"])


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)

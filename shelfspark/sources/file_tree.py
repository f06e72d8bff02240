"""A folder of files, one for each row, written with a commit (K1).

Tasks put their files below a staging folder that belongs to the job, each under a temporary name first, and tell
the driver how many they wrote.  When all tasks are done, the driver puts the staged folder in place of the old one, by
renaming; when one fails for good, it deletes the staged folder, and the old one stays as it was.  Files are written
through ``pyarrow.fs``, so a folder is a mounted path or a URI of one of its stores, shared by all machines.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "shelf_file_tree"


@dataclass
class Written(WriterCommitMessage):
    files: int


class FileTreeWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _places(self):
        from pyarrow import fs

        store, target = fs.FileSystem.from_uri(self.path)
        head, name = posixpath.split(target)
        return store, target, f"{head}/.{name}-{self.job}", f"{head}/.{name}-{self.job}-old"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, _, staged, _ = self._places()
        n, made = 0, set()
        for row in iterator:
            parts = row["rel_path"].split("/")
            if not row["rel_path"] or any(p in ("", ".", "..") for p in parts):
                raise ValueError(f"not a path inside the folder: {row['rel_path']!r}")
            folder = "/".join([staged, *parts[:-1]])
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(row["content"].encode())
            store.move(part, f"{folder}/{parts[-1]}")  # a second attempt of the task writes the same
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, target, staged, old = self._places()
        store.create_dir(staged, recursive=True)  # also when there was no row
        if store.get_file_info(target).type != fs.FileType.NotFound:
            store.move(target, old)
            store.move(staged, target)
            store.delete_dir(old)
        else:
            store.move(staged, target)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, _, staged, _ = self._places()
        if store.get_file_info(staged).type != fs.FileType.NotFound:
            store.delete_dir(staged)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "rel_path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not overwrite:
            raise ValueError("a file tree is replaced as a whole: use mode overwrite")
        return FileTreeWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Replace the folder ``path`` by ``files[rel_path, content]``.  Of rows with one path any one stays."""
    files.sparkSession.dataSource.register(FileTree)
    files.select("rel_path", "content").write.format(FORMAT).mode("overwrite").save(path)

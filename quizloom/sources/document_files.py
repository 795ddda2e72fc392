"""A data source of one text file a document, for Markdown that other programs read: spark.read.format("document_files").

Paths are those of any file system that Arrow knows by its address, local ones included.
Tasks write below a folder of their own; the commit moves files to their places and an
abort removes them, so a task that is repeated or lost leaves nothing behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of the files that one task reads, unless a single one is larger; files that the commit moves side by side.
PARTITION_BYTES, MOVES = 64 << 20, 32
PENDING = "_pending"


def _opened(options: dict) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(options["path"]) if "://" in options["path"] or options["path"].startswith("file:") else (fs.LocalFileSystem(), options["path"])
    return system, root.rstrip("/")


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Files]:
        system, root = _opened(self.options)
        ends = tuple(e for e in self.options.get("suffixes", "").lower().split(",") if e)
        out, held = [Files([])], 0
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            inside = info.path[len(root) + 1 :]
            if info.type != fs.FileType.File or inside.startswith(PENDING) or ends and not inside.lower().endswith(ends):
                continue
            if out[-1].paths and held + info.size > PARTITION_BYTES:
                out, held = [*out, Files([])], 0
            out[-1].paths.append(inside)
            held += info.size
        return out

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        system, root = _opened(self.options)
        for name in partition.paths:
            with system.open_input_stream(f"{root}/{name}") as f:
                yield name, f.read().decode("utf-8", "ignore")


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.options = options

    def write(self, iterator: Iterator) -> Written:
        system, root = _opened(self.options)
        folder, names = f"{PENDING}/{uuid.uuid4().hex}", []
        system.create_dir(f"{root}/{folder}", recursive=True)
        for row in iterator:
            name = row["path"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a path below the folder: {name!r}")
            with system.open_output_stream(f"{root}/{folder}/{len(names)}") as f:
                f.write((row["text"] or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.options)
        moves = [(f"{root}/{m.folder}/{i}", f"{root}/{name}") for m in messages if m for i, name in enumerate(m.names)]
        for parent in sorted({to.rpartition("/")[0] for _, to in moves}):
            system.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda m: system.move(*m), moves))
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.options))

    @staticmethod
    def _clear(system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{PENDING}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{PENDING}")


class DocumentFiles(DataSource):
    """Rows (path below the folder, text).  Options: path, and for reading suffixes, parted by commas.

    Of rows with one path the file of one stays; bytes that aren't UTF-8 are left out; a null text is an empty file.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "path string, text string"

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)

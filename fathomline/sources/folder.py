"""Documents of a folder as a Spark data source: files packed into partitions by their bytes, a row for each, unreadable ones too."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

SCHEMA = "path string, length bigint, modified timestamp, content binary, kind string, message string"
#: Spark's own limit of a value.
MOST = (1 << 31) - 16


def opened(uri: str):
    """(file system, path, prefix that makes a path of it a URI) of a folder in any store that pyarrow opens; a plain path is a local one."""
    import pyarrow.fs

    full = uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}"
    fs, path = pyarrow.fs.FileSystem.from_uri(full)
    return fs, path, full[: len(full) - len(path)] if full.endswith(path) else full.partition("://")[0] + "://"


def listed(fs, base: str) -> Iterator[tuple[str, int, float | None, str | None]]:
    """(path, length, seconds of its last change, what is wrong with it) of each file below a folder; of local ones those too whose link leads nowhere."""
    import pyarrow.fs

    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        for info in fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)):
            if info.type != pyarrow.fs.FileType.Directory:
                yield info.path, info.size or 0, info.mtime.timestamp() if info.mtime else None, "no file there" if info.type == pyarrow.fs.FileType.NotFound else None
        return
    if not os.path.isdir(base):
        raise FileNotFoundError(f"no folder at {base}")
    for folder, _, names in os.walk(base):
        for name in sorted(names):
            path = os.path.join(folder, name)
            try:
                found = os.stat(path)
                yield path, found.st_size, found.st_mtime, None
            except OSError as e:
                yield path, 0, None, str(e)


@dataclass
class Files(InputPartition):
    """(path, length, seconds of its last change, what is wrong with it already) of each file."""

    files: list[tuple[str, int, float | None, str | None]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.glob = options["path"], options.get("glob", "*")
        self.pack, self.most = int(options.get("packbytes", 128 << 20)), min(MOST, int(options.get("maxbytes", MOST)))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """What is asked of path and length is settled by the listing; no file is opened for others."""
        kinds = {EqualTo: "==", In: "in", StringStartsWith: "starts", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and f.attribute in (("path",), ("length",)):
                self.tests.append((kinds[type(f)], f.attribute[0], f.value))
            else:
                yield f

    def _asked(self, path: str, length: int) -> bool:
        check = {
            "==": lambda x, y: x == y, "in": lambda x, y: x in y, "starts": lambda x, y: x.startswith(y), ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y,
        }
        return all(check[kind](path if name == "path" else length, value) for kind, name, value in self.tests)

    def partitions(self) -> list[Files]:
        fs, base, scheme = opened(self.folder)
        packs, held, size = [], [], 0
        for path, length, changed, wrong in listed(fs, base):
            if not fnmatch.fnmatch(path.rpartition("/")[2], self.glob) or not self._asked(scheme + path, length):
                continue
            if wrong is None and length > self.most:
                wrong = f"{length} bytes are more than {self.most}"
            held.append((path, length, changed, wrong))
            size += 0 if wrong else length
            if size >= self.pack or len(held) >= 10_000:
                packs.append(Files(held))
                held, size = [], 0
        return [*packs, Files(held)] if held or not packs else packs

    def read(self, partition: Files) -> Iterator[tuple]:
        import datetime

        fs, _, scheme = opened(self.folder)
        for path, length, changed, wrong in partition.files:
            content = None
            if wrong is None:
                try:
                    with fs.open_input_stream(path) as file:
                        content = file.read()
                except OSError as e:
                    wrong = str(e)
            when = None if changed is None else datetime.datetime.fromtimestamp(changed, datetime.timezone.utc)
            yield scheme + path, length, when, content, None if wrong is None else "artifact_unreadable", None if wrong is None else f"can't read {scheme + path}: {wrong}"


class Documents(DataSource):
    """Options: path (a folder), glob (of file names), packbytes (of a partition), maxbytes (of a file)."""

    @classmethod
    def name(cls) -> str:
        return "fathomline_documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        if "path" not in self.options:
            raise ValueError("load() needs a folder")
        return Reader(dict(self.options))


def read_folder(spark: SparkSession, path: str, glob: str = "*", **options: str) -> DataFrame:
    """path, length, modified, content, kind, message of each file below a folder.

    A file that can't be read (gone, forbidden, longer than maxbytes) has no content and kind artifact_unreadable: the others
    are read all the same. Filters on path and length choose files before any is opened."""
    spark.dataSource.register(Documents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(Documents.name()).options(glob=glob, **options).load(path)

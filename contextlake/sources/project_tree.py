"""A data source that reads the files of a project tree.

Spark's own file sources hide names that start with ``_`` or ``.``; this one lists what the rules of the project keep.
The driver lists names and sizes only, and holds those of at most ``maxFiles`` files; files are read by the executors, in
partitions of about ``BATCH_BYTES``.
"""

from __future__ import annotations

import datetime
import heapq
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_BYTES = 16 << 20
SCHEMA = "path string, language string, size_bytes bigint, modified_at timestamp, content string"


class Batch(InputPartition):
    """Files of one partition."""

    def __init__(self, files: list[tuple[str, int, float]]):
        super().__init__(0)
        self.files = files


class ProjectReader(DataSourceReader):
    """Lists on the driver, reads on the executors."""

    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options.get("path", "."))
        self.sub = options.get("subpath", "").strip("/")
        self.extensions = {e for e in options.get("extensions", "").lower().split(",") if e}
        self.most_bytes = int(options.get("maxfilesize", 1 << 20))
        self.most_files = int(options.get("maxfiles", 50_000))
        joined = "|".join(p for p in options.get("ignoreregex", "").split("\n") if p)
        self.ignore = re.compile(joined, re.I) if joined else None
        self.texts = [t for t in options.get("ignoretext", "").split("\n") if t]
        self.skipped = {d for d in options.get("skipdirs", "").split(",") if d}

    def _kept(self, path: str) -> bool:
        return not (self.ignore and self.ignore.search(path)) and not any(t in path for t in self.texts)

    def listing(self) -> list[tuple[str, int, float]]:
        """Path, size and time of the files to read, by path; folders that are ignored aren't entered."""
        return heapq.nsmallest(self.most_files, self._walk())

    def _walk(self) -> Iterator[tuple[str, int, float]]:
        for folder, names, files in os.walk(os.path.join(self.root, self.sub), onerror=None):
            inside = os.path.relpath(folder, self.root).replace(os.sep, "/")
            inside = "" if inside == "." else inside + "/"
            names[:] = sorted(n for n in names if n not in self.skipped and self._kept(inside + n) and self._kept(inside + n + "/"))
            for name in files:
                path = inside + name
                if self.extensions and os.path.splitext(name)[1][1:].lower() not in self.extensions or not self._kept(path):
                    continue
                try:
                    status = os.stat(os.path.join(folder, name))
                except OSError:
                    continue
                if 0 < status.st_size <= self.most_bytes:
                    yield path, status.st_size, status.st_mtime

    def partitions(self) -> list[Batch]:
        batches: list[list[tuple[str, int, float]]] = [[]]
        held = 0
        for item in self.listing():
            if held + item[1] > BATCH_BYTES and batches[-1]:
                batches.append([])
                held = 0
            batches[-1].append(item)
            held += item[1]
        return [Batch(b) for b in batches]

    def read(self, partition: Batch) -> Iterator[tuple]:
        for path, size, modified in partition.files:
            try:
                with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="") as file:
                    text = file.read()
            except OSError:
                continue
            yield path, os.path.splitext(path)[1][1:].lower(), size, datetime.datetime.fromtimestamp(modified, datetime.timezone.utc), text


class ProjectTree(DataSource):
    """``spark.read.format("projtree")``; options path, subPath, extensions, maxFileSize, maxFiles, and what to leave out:
    ignoreRegex (patterns, a line each), ignoreText (parts of paths, a line each) and skipDirs (names of directories)."""

    @classmethod
    def name(cls) -> str:
        return "projtree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProjectReader:
        return ProjectReader({k.lower(): v for k, v in self.options.items()})


def missing(stored: DataFrame, root: str) -> DataFrame:
    """The rows of ``stored`` (path first) whose path isn't a file beneath ``root`` any more; each is looked up where its row
    is, so nothing is listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not os.path.isfile(os.path.join(root, p)) for p in batch.column("path").to_pylist()], pa.bool_()))

    return stored.filter("path is not null").mapInArrow(run, stored.schema)

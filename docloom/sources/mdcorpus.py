"""The `mdcorpus` data source: a folder tree of Markdown files, for batch and streaming reads.

Spark's file sources skip names that start with '_' or '.', which corpora use for archives; this source reads them.
Options: path, extensions (default md), exclude (substrings, ';' between), root_only, max_depth, include_hidden,
skip_prefixes (';' between), follow_links. Files are listed on the driver and read in partitions of about 4 MB. A file
that is no UTF-8 is skipped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "path string, content string, mtime timestamp, size long, is_symlink boolean"
PARTITION_BYTES = 4 << 20


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def listing(options: dict) -> list[tuple[str, str, float, int]]:
    """(path within the corpus, file, mtime, size) by path."""
    root = options["path"].removeprefix("file://")
    flag = lambda name, default="false": str(options.get(name, default)).lower() == "true"
    split = lambda name: [x for x in options.get(name, "").split(";") if x]
    endings = tuple("." + x for x in (split("extensions") or ["md"]))
    exclude, skip, deepest = split("exclude"), tuple(split("skip_prefixes")), int(options.get("max_depth", 1 << 30))
    out = []
    for folder, folders, names in os.walk(root, followlinks=flag("follow_links")):
        depth = 0 if folder == root else os.path.relpath(folder, root).count(os.sep) + 1
        folders[:] = [] if flag("root_only") or depth + 1 >= deepest else sorted(f for f in folders if flag("include_hidden", "true") or not f.startswith("."))
        for name in sorted(names):
            path = os.path.relpath(os.path.join(folder, name), root)
            if not name.endswith(endings) or (name.startswith(".") and not flag("include_hidden", "true")) or (skip and name.startswith(skip)) or any(x in path for x in exclude):
                continue
            s = os.stat(os.path.join(folder, name))
            out.append((path, os.path.join(folder, name), s.st_mtime, s.st_size))
    return sorted(out)


def rows(files: list[tuple[str, str]]) -> Iterator[tuple]:
    for path, file in files:
        try:
            with open(file, "rb") as f:
                content = f.read().decode()
        except (UnicodeDecodeError, FileNotFoundError):
            continue
        s = os.stat(file)
        yield path, content, datetime.fromtimestamp(s.st_mtime, timezone.utc), s.st_size, os.path.islink(file)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        out, now, size = [], [], 0
        for path, file, _, n in listing(self.options):
            if now and size + n > PARTITION_BYTES:
                out.append(Files(now))
                now, size = [], 0
            now.append((path, file))
            size += n
        return [*out, Files(now)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows(partition.files)


class StreamReader(SimpleDataSourceStreamReader):
    """Files that changed since the last batch; the offset is the latest time seen and the files that have it."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"mtime": -1.0, "paths": ""}

    def _changed(self, start: dict, end: dict | None) -> list[tuple[str, str, float, int]]:
        seen = set(start["paths"].split("\n"))
        late = [f for f in listing(self.options) if f[2] > start["mtime"] or f[2] == start["mtime"] and f[0] not in seen]
        return late if end is None else [f for f in late if f[2] <= end["mtime"]]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = self._changed(start, None)
        if not found:
            return iter(()), start
        last = max(f[2] for f in found)
        paths = [f[0] for f in found if f[2] == last] + (start["paths"].split("\n") if start["mtime"] == last else [])
        return iter(list(rows([f[:2] for f in found]))), {"mtime": last, "paths": "\n".join(sorted(paths))}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(rows([f[:2] for f in self._changed(start, end)])))


class MarkdownCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mdcorpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(MarkdownCorpus)

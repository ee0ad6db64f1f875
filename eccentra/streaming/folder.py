"""Files of a watched folder as a stream that waits until they are complete.

A file is released once two listings, at least ``settle`` seconds apart, agree on
its size and time; while it grows it is held back. Files are released oldest
first. The offset of the stream is the listing: for every file present its size
and time, since when these are known, and whether it has been released; so a
restarted query goes on where it stopped, and a file that is written anew is
released anew. With ``archive`` set, released files move there once their batch
is done, and offsets stay as small as the folder.

The driver lists names and sizes only; contents are read by ``lines_of`` in the tasks.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, size long, modified timestamp"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's name, with or without a scheme."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") else path)
    return fs.LocalFileSystem(), path


def listing(path: str) -> dict[str, tuple[int, int]]:
    """(size, time in microseconds) of the files of a folder by name; hidden and unfinished ones are left out."""
    files, at = opened(path)
    found = files.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return {f.base_name: (f.size, f.mtime_ns // 1000) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def advanced(start: dict, now: dict[str, tuple[int, int]], clock: int, settle: int) -> dict:
    """The offset after a listing: ``files`` by name with stamp, since when it is known, and whether it is released."""
    before, out = start.get("files", {}), {}
    for name, (size, modified) in now.items():
        stamp, old = f"{size}:{modified}", before.get(name)
        if old is None or old["stamp"] != stamp:
            out[name] = {"stamp": stamp, "since": clock, "free": False}
        else:
            out[name] = {**old, "free": old["free"] or clock - old["since"] >= settle}
    return {"files": out}


def released(start: dict, end: dict) -> list[tuple[str, int, int]]:
    """(name, size, time) of the files set free between two offsets, oldest first."""
    before, out = start.get("files", {}), []
    for name, f in end.get("files", {}).items():
        if f["free"] and not (name in before and before[name]["free"] and before[name]["stamp"] == f["stamp"]):
            size, modified = map(int, f["stamp"].split(":"))
            out.append((name, size, modified))
    return sorted(out, key=lambda r: (r[2], r[0]))


class FolderReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.archive = options["path"].rstrip("/"), options.get("archive")
        self.settle = int(float(options.get("settle", "5")) * 1e6)
        self.first = True

    def initialOffset(self) -> dict:
        return {"files": {}}

    def _rows(self, start: dict, end: dict) -> Iterator[tuple]:
        from datetime import datetime, timezone

        return iter([(f"{self.path}/{name}", size, datetime.fromtimestamp(modified / 1e6, timezone.utc)) for name, size, modified in released(start, end)])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = advanced(start, listing(self.path), int(time.time() * 1e6), self.settle)
        return self._rows(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start, end)

    def commit(self, end: dict) -> None:
        if not self.archive:
            return
        files, at = opened(self.path)
        _, to = opened(self.archive)
        there = listing(self.path)
        files.create_dir(to, recursive=True)
        for name, f in end.get("files", {}).items():
            if f["free"] and name in there and f["stamp"] == "{}:{}".format(*there[name]):
                files.move(f"{at}/{name}", f"{to}/{name}")


class ArrivingFiles(DataSource):
    """Options: ``path``, ``settle`` (seconds, 5), ``archive`` (a folder, none)."""

    @classmethod
    def name(cls) -> str:
        return "arriving_files"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def complete_files(spark: SparkSession, path: str, settle: float = 5, archive: str | None = None) -> DataFrame:
    """Stream of (path, size, modified) of the files of ``path`` once they are complete."""
    spark.dataSource.register(ArrivingFiles)
    r = spark.readStream.format("arriving_files").option("path", path).option("settle", str(settle))
    return (r.option("archive", archive) if archive else r).load()


def lines_of(files: DataFrame, parts: int, block: int = 1 << 20) -> DataFrame:
    """(path, line) of text files, read in ``parts`` tasks in blocks of bytes."""
    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = opened(path)
                with store.open_input_stream(at) as source:
                    rest = b""
                    while data := source.read(block):
                        *lines, rest = (rest + data).split(b"\n")
                        if lines:
                            yield rows(path, lines)
                    if rest:
                        yield rows(path, [rest])

    def rows(path, lines):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array([x.decode() for x in lines])], ["path", "line"])

    return files.select("path").repartition(parts).mapInArrow(run, "path string, line string")

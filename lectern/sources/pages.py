"""Folders of pages as a data source of Spark, read whole or as a stream, with retries.

A folder holds files of JSON lines (url, html), any number of pages a file. Files are the partitions, so tasks read them
side by side and the driver lists names only. A file that can't be opened is tried again after a wait that doubles; one
that fails every time gives a row with nulls, its name and the number of tries, so that nothing is lost in silence. A
file passes through its task a piece at a time; one that fails halfway goes on behind the pieces that were read.
"""

from __future__ import annotations

import importlib
import io
import json
import time
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: First wait in seconds, what each wait is of the one before, the longest, and tries.
FIRST, FACTOR, LONGEST, TRIES = 1.0, 2.0, 60.0, 5
#: Characters of a piece of a file, about.
PIECE = 4 << 20
#: Answers that ask to come again later, and of which the last is waited for too.
BUSY = (429, 503)


class Refused(OSError):
    """An opener's answer other than the content; ``status`` as of HTTP."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def retried[X](read: Callable[[], X], tries: int = TRIES, first: float = FIRST, factor: float = FACTOR, longest: float = LONGEST, wait: Callable[[float], None] = time.sleep) -> tuple[X | None, int]:
    """What ``read`` gives and the number of tries it took; nothing after ``tries`` failures (OSError). There is a wait
    between two tries, and also after the last where the answer was that the server is busy."""
    delay = first
    for k in range(1, tries + 1):
        try:
            return read(), k
        except OSError as failed:
            if k < tries or getattr(failed, "status", None) in BUSY:
                wait(delay)
                delay = min(delay * factor, longest)
    return None, tries


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def opened(path: str) -> str:
    """A file's text, through the file system of its path."""
    files, name = _place(path)
    with files.open_input_stream(name) as f:
        return f.read().decode()


def opened_lines(path: str) -> Iterator[str]:
    """A file's lines as they are asked for, through the file system of its path."""
    files, name = _place(path)
    with io.TextIOWrapper(files.open_input_stream(name), encoding="utf-8", newline="\n") as f:
        yield from f


def piece(lines: Iterable[str]) -> list[str]:
    """The next lines, of ``PIECE`` characters or a bit more."""
    out, size = [], 0
    for line in lines:
        out.append(line)
        size += len(line) + 1
        if size >= PIECE:
            break
    return out


def names(folder: str) -> list[str]:
    """The files of a folder in order, without those that begin with a dot or an underscore."""
    from pyarrow import fs

    files, name = _place(folder)
    found = files.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")


class _File(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Pages:
    """How a file of the folder is read."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.opener = options.get("opener", f"{__name__}:opened_lines")
        self.tries, self.first, self.longest = int(options.get("tries", TRIES)), float(options.get("wait", FIRST)), float(options.get("longest", LONGEST))

    def pieces(self, name: str) -> Iterator[tuple[list[str] | None, int]]:
        """The lines of a file, some at a time, with the most tries that it took so far; nothing instead of lines at the
        end of a file that fails every time."""
        module, own = self.opener.split(":")
        read, lines, done, most = getattr(importlib.import_module(module), own), None, 0, 1

        def some() -> list[str]:
            nonlocal lines
            try:
                if lines is None:
                    found = read(f"{self.folder}/{name}")
                    lines = islice(found.split("\n") if isinstance(found, str) else found, done, None)
                return piece(lines)
            except OSError:
                lines = None
                raise

        while True:
            found, tries = retried(some, self.tries, self.first, longest=self.longest)
            most = max(most, tries)
            if found is None or found:
                yield found, most
            if not found:
                return
            done += len(found)

    def rows(self, name: str) -> Iterator[pa.RecordBatch]:
        for lines, tries in self.pieces(name):
            pages = [{}] if lines is None else [json.loads(line) for line in lines if line.strip()]
            columns = [*(pa.array([page.get(c) for page in pages], pa.string()) for c in ("url", "html")), pa.array([name] * len(pages), pa.string()), pa.array([tries] * len(pages), pa.int32())]
            yield pa.record_batch(columns, ["url", "html", "file", "tries"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self) -> list[_File]:
        return [_File(n) for n in names(self.pages.folder)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        # an empty folder has no partitions, for which the engine asks once with None
        return iter(()) if partition is None else self.pages.rows(partition.name)


class _StreamReader(DataSourceStreamReader):
    """Offsets are names of files; new files have to sort behind those that were read."""

    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(names(self.pages.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(n) for n in names(self.pages.folder) if start["file"] < n <= end["file"]]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        return self.pages.rows(partition.name)

    def commit(self, end: dict) -> None:
        pass


class PageFolder(DataSource):
    """``page_folder``: url, html, file and tries. Options: path; opener (module:function of a path to its text or its lines); tries,
    wait (the first, in seconds) and longest."""

    @classmethod
    def name(cls) -> str:
        return "page_folder"

    def schema(self) -> str:
        return "url string, html string, file string, tries int"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFolder)

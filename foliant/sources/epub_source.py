"""A folder of EPUB files as a data source: spark.read.format("epub"), df.write.format("epub").

Reading gives a row a chapter, and one row with its status for a file that is refused or has none. The driver lists
names and sizes; files are dealt into partitions of about the same bytes, and comparisons of `size` and `path` are
answered from the listing, so files that they rule out are never opened. No more than the limit of a file is read, whatever its listed size.

Writing takes (path, archive). Tasks write files of their own names into the folder of a version; the commit puts a
manifest of all that were written in place by one rename, so they appear together, and a job that dies before that
leaves the folder as it was. Overwriting starts a new manifest, appending extends the last (a name that comes again replaces
its file); `vacuum` removes what no manifest names. A folder without a manifest is read as it is.

Paths are those that pyarrow's file systems open (local, hdfs, s3, gs). Options: path, maxBytes, maxEntries, maxUncompressed,
partitionBytes. A null archive, a name with a folder in it and a name that is written twice fail the job.
"""

from __future__ import annotations

import heapq
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from foliant.functions import fixed
from foliant.sources import epub

MANIFEST = "_books.json"
_ROW = {"path": pa.string(), "size": pa.int64(), "status": pa.string(), "title": pa.string(), **epub._CHAPTER}
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def listing(files: fs.FileSystem, root: str) -> list[tuple[str, str, int]]:
    """name, place and size of each book: what the manifest names, or all *.epub files of a folder without one."""
    at = f"{root}/{MANIFEST}"
    if files.get_file_info(at).type == fs.FileType.File:
        with files.open_input_stream(at) as f:
            return [(name, f"{root}/{x['at']}", x["size"]) for name, x in sorted(json.loads(f.read())["books"].items())]
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x.path[len(root) :].lstrip("/"), x.path, x.size) for x in found if x.type == fs.FileType.File and x.extension == "epub")


def shares(books: list[tuple[str, str, int]], partition_bytes: int) -> list[list[tuple[str, str, int]]]:
    """Books dealt into parts of nearly equal bytes: the largest first, each to the part that has least."""
    n = max(1, min(len(books), -(-sum(b[2] for b in books) // partition_bytes)))
    heap, out = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for book in sorted(books, key=lambda b: -b[2]):
        held, k = heapq.heappop(heap)
        out[k].append(book)
        heapq.heappush(heap, (held + book[2], k))
    return [x for x in out if x]


@dataclass
class Share(InputPartition):
    books: list[tuple[str, str, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.tests = options["path"], []
        self.partition_bytes = int(options.get("partitionbytes", 128 << 20))
        self.limits = epub.Limits(int(options.get("maxbytes", fixed.MAX_ARCHIVE_BYTES)), int(options.get("maxentries", fixed.MAX_ENTRIES)), int(options.get("maxuncompressed", fixed.MAX_UNCOMPRESSED)))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("size",), ("path",)):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Share]:
        books = listing(*opened(self.path))
        for column, test, value in self.tests:
            books = [b for b in books if _TESTS[test](b[0] if column == "path" else b[2], value)]
        return [Share(x) for x in shares(books, self.partition_bytes)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return epub.together(self._chapters(partition.books), pa.schema(list(_ROW.items())))

    def _chapters(self, books: list[tuple[str, str, int]]) -> Iterator[tuple[list[dict], int]]:
        files, _ = opened(self.path)
        for name, place, size in books:  # one archive in memory at a time
            raw = None
            if size <= self.limits.archive_bytes:
                with files.open_input_stream(place) as f:
                    raw = f.read(self.limits.archive_bytes + 1)
            book = epub.unpack(raw, self.limits)
            chapters = book["chapters"] or [dict.fromkeys(epub._CHAPTER)]
            yield [{"path": name, "size": size, "status": book["status"], "title": book["title"], **c} for c in chapters], sum(len(c["content"] or "") for c in chapters)


@dataclass
class Written(WriterCommitMessage):
    books: dict[str, dict]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.version = options["path"], overwrite, f"v-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        files.create_dir(f"{root}/{self.version}", recursive=True)
        attempt, out = TaskContext.get().taskAttemptId(), {}
        for batch in iterator:
            for i in range(batch.num_rows):
                name, archive = batch.column("path")[i].as_py(), batch.column("archive")[i].as_py()
                if archive is None or not name or "/" in name or "\\" in name or name in out:
                    raise ValueError(f"no book to write, or no name for it: {name!r}")
                at = f"{self.version}/{attempt}-{len(out)}.epub"
                with files.open_output_stream(f"{root}/{at}") as f:
                    f.write(archive)
                out[name] = {"at": at, "size": len(archive)}
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        fresh = [b for m in messages if m for b in m.books.items()]
        if len({name for name, _ in fresh}) < len(fresh):
            self.abort(messages)
            raise ValueError("a name is written twice")
        files.create_dir(root, recursive=True)
        at, kept = f"{root}/{MANIFEST}", {}
        if not self.overwrite and files.get_file_info(at).type == fs.FileType.File:
            with files.open_input_stream(at) as f:
                kept = json.loads(f.read())["books"]
        with files.open_output_stream(f"{at}.{self.version}") as f:
            f.write(json.dumps({"books": kept | dict(fresh)}).encode())
        files.move(f"{at}.{self.version}", at)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        if files.get_file_info(f"{root}/{self.version}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.version}")


def vacuum(path: str) -> int:
    """Removes files of versions that the manifest no longer names (replaced, or left by tasks that died); no reader may be at work."""
    files, root = opened(path)
    named = {place for _, place, _ in listing(files, root)}
    old = [x.path for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and "/v-" in x.path and x.path not in named]
    for place in old:
        files.delete_file(place)
    return len(old)


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return "path string, size long, status string, title string, spine_pos long, item_id string, href string, media_type string, content string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into its listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EpubSource)

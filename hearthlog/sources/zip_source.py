"""ZIP parts as a Python data source: several tasks read one part, by ranges of its directory, and nothing is read whole.

`register(spark)` once, then `read_zips(spark, folder, rows)`, or `spark.read.format("zip_parts").option("rows", ...)`:

* `entries`: the directories, without inflating anything;
* `texts`: a row for each JSON or HTML entry within its limit, with its text;
* `chunks`: entries as pieces of at most `chunk_bytes`;
* `pages`: HTML entries through the streaming tokeniser: a row for each card and, behind them, one for the page.

Filters on section, format, part_path and path are applied before an entry is opened, those on part_path before a part
is. What can't be read gives a row with `error`: a file that isn't a ZIP, a broken or encrypted entry, a text over its
limit, a folder over the limits of discovery.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from hearthlog.functions import scalars as S
from hearthlog.sources import html_records

#: Limits of an import.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_JSON_BYTES, MOST_HTML_BYTES = 100_000, 2 << 30, 20 << 20, 512 << 20
#: Limits of a folder's discovery.
MOST_DEPTH, MOST_FOLDERS, MOST_FILES, MOST_VISITED = 8, 2_000, 10_000, 50_000
#: Entries of a part that is written here; well below MOST_ENTRIES, as each task that reads a part parses its directory.
PART_ENTRIES = 20_000

ENTRY = "part_path string, path string, section string, format string, size long, packed long, crc long, error string"
SCHEMAS = {"entries": ENTRY, "texts": f"{ENTRY}, text string", "chunks": f"{ENTRY}, chunk int, data binary", "pages": f"{ENTRY}, {html_records.STREAMED}"}
_ARROW = {
    "entries": [("part_path", pa.string()), ("path", pa.string()), ("section", pa.string()), ("format", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64()), ("error", pa.string())],
}
_ARROW["texts"] = [*_ARROW["entries"], ("text", pa.string())]
_ARROW["chunks"] = [*_ARROW["entries"], ("chunk", pa.int32()), ("data", pa.binary())]
_ARROW["pages"] = [*_ARROW["entries"], *html_records.STREAMED_ARROW]
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipParts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_zips(spark: SparkSession, folder: str, rows: str = "entries", **options) -> DataFrame:
    """The rows of every *.zip below a folder (or of one file); a path or any URI that Arrow's file systems know."""
    register(spark)
    return spark.read.format("zip_parts").options(rows=rows, **{k: str(v) for k, v in options.items()}).load(folder)


def section_of(path: str) -> str | None:
    """scalars.section for one path."""
    low = path.translate(_LOWER)
    if re.search(r"\.(json|html?)$", low):
        return next((name for name, pattern in S.SECTION_MARKS if re.search(pattern, low)), None)
    return None


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def format_of(path: str) -> str | None:
    end = re.search(r"\.(json|html?)$", path.translate(_LOWER))
    return end and ("json" if end[1] == "json" else "html")


@dataclass
class Range(InputPartition):
    """Entries first to last - 1 of a part, or what is wrong with it."""

    part_path: str
    first: int = 0
    last: int = 0
    error: str | None = None


class ZipParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_parts"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "entries")]

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(dict(self.options))


def system_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", folder))
    return fs.LocalFileSystem(), folder


def discover(system: fs.FileSystem, root: str, depth: int = MOST_DEPTH, folders: int = MOST_FOLDERS, files: int = MOST_FILES, visited: int = MOST_VISITED) -> tuple[list[fs.FileInfo], list[str]]:
    """The *.zip files below `root` by name, and what the limits left out."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info], []
    found, told, queue, seen, entered = [], [], [(root, 0)], 0, 0
    while queue:
        folder, level = queue.pop(0)
        if level > depth:
            told.append(f"folder limit: depth of {depth} near {folder.rsplit('/', 1)[-1]}")
            continue
        entered += 1
        if entered > folders:
            return found, [*told, f"folder limit: {folders} folders"]
        for x in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
            seen += 1
            if seen > visited:
                return found, [*told, f"folder limit: {visited} entries"]
            if x.type == fs.FileType.Directory:
                queue.append((x.path, level + 1))
            elif x.base_name.lower().endswith(".zip"):
                if len(found) >= files:
                    return found, [*told, f"folder limit: {files} ZIP files"]
                found.append(x)
    return found, told


def write_parts(files: DataFrame, folder: str, entries: int = PART_ENTRIES) -> None:
    """Writes `files` (path, text) as ZIP parts of at most so many entries, one or more for each partition; a part appears under its name when it is whole.

    A task that runs twice writes the same parts under the same names.
    """
    entries = min(entries, MOST_ENTRIES)  # readers refuse parts with more
    system, root = system_of(folder)
    system.create_dir(root, recursive=True)  # also where there is nothing to write

    def run(batches):
        (system, root), context = system_of(folder), TaskContext.get()
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        first, k, total = next(rows, None), 0, 0
        while first or not k:
            name, n = f"{root}/part-{context.partitionId():05}-{k:05}.zip", 0
            hidden = f"{name}.{context.taskAttemptId()}.tmp"
            with system.open_output_stream(hidden) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for path, text in chain([first] if first else [], islice(rows, entries - 1)):
                    z.writestr(path, (text or "").encode())
                    n += 1
            system.move(hidden, name)
            first, k, total = next(rows, None), k + 1, total + n
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["entries"])

    files.select("path", "text").mapInArrow(run, "entries long").agg({"entries": "sum"}).collect()


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rows = options.get("rows", "entries")
        self.folder = options["path"]
        self.per_task = int(options.get("entries_per_task", 2_000))
        self.task_bytes = int(options.get("bytes_per_task", 64 << 20))
        self.chunk = int(options.get("chunk_bytes", 1 << 20))
        self.limits = {k: int(options[f"most_{k}"]) for k in ("depth", "folders", "files", "visited") if f"most_{k}" in options}
        self.limit = {"json": int(options.get("most_json_bytes", MOST_JSON_BYTES)), "html": int(options.get("most_html_bytes", MOST_HTML_BYTES))}
        self.tests: list[tuple[str, str, object]] = []

    # -- planning

    def pushFilters(self, filters: list[Filter]):
        known = {EqualTo: "equal", In: "in", StringEndsWith: "ends", StringStartsWith: "starts", StringContains: "contains"}
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if type(f) in known and column in ("section", "format", "part_path", "path"):
                self.tests.append((column, known[type(f)], f.value))
            elif isinstance(f, IsNotNull) and column in ("section", "format", "part_path", "path"):
                self.tests.append((column, "known", None))
            else:
                yield f

    def _fits(self, **values: str | None) -> bool:
        def holds(x: str | None, test: str, value) -> bool:
            if x is None:
                return False
            return {"equal": lambda: x == value, "in": lambda: x in value, "ends": lambda: x.endswith(value), "starts": lambda: x.startswith(value), "contains": lambda: value in x, "known": lambda: True}[test]()

        return all(holds(values[c], test, v) for c, test, v in self.tests if c in values)

    def _system(self) -> tuple[fs.FileSystem, str]:
        return system_of(self.folder)

    def partitions(self) -> list[Range]:
        """Ranges of some entries and bytes of each part, from its directory; a part that has none stands for its error."""
        system, root = self._system()
        found, told = discover(system, root.rstrip("/"), **self.limits)
        wanted = [x.path for x in found if self._fits(part_path=x.path)]
        with ThreadPoolExecutor(16) as pool:  # waits for small reads at the files' ends
            ranges = [r for part in pool.map(lambda p: self._ranges(system, p), wanted) for r in part]
        return ranges + [Range("", error=t) for t in told] or [Range("")]

    def _ranges(self, system: fs.FileSystem, path: str) -> list[Range]:
        try:
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                sizes = [i.compress_size for i in z.infolist()]
        except _BROKEN as e:
            return [Range(path, error=f"not a readable ZIP: {type(e).__name__}")]
        if len(sizes) > MOST_ENTRIES:
            return [Range(path, error=f"too many entries: {len(sizes)}")]
        out, first, held = [], 0, 0
        for k, size in enumerate(sizes):
            if k > first and (k - first >= self.per_task or held + size > self.task_bytes):
                out.append(Range(path, first, k))
                first, held = k, 0
            held += size
        return [*out, Range(path, first, len(sizes))]

    # -- reading

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        batch, held = [], 0
        for row, size in self._rows(partition):
            batch.append(row)
            held += size + 200
            if held > 4 << 20 or len(batch) >= 10_000:
                yield self._batch(batch)
                batch, held = [], 0
        if batch:
            yield self._batch(batch)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = _ARROW[self.rows]
        return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def _rows(self, p: Range) -> Iterator[tuple[tuple, int]]:
        """Rows and the bytes that each holds besides its entry."""
        if p.error:
            if self._fits(part_path=p.part_path or None, path=None, section=None, format=None):
                yield (p.part_path or None, None, None, None, None, None, None, p.error), 0
            return
        if p.first == p.last:
            return
        system, _ = self._system()
        with system.open_input_file(p.part_path) as file, zipfile.ZipFile(file) as z:
            for i in z.infolist()[p.first : p.last]:
                head = (p.part_path, i.filename, section_of(i.filename), format_of(i.filename), i.file_size, i.compress_size, i.CRC)
                if i.is_dir() or not self._fits(part_path=head[0], path=head[1], section=head[2], format=head[3]):
                    continue
                if i.file_size > MOST_ENTRY_BYTES and self.rows != "chunks":
                    yield (*head, "very large entry was not opened"), 0
                elif self.rows == "entries":
                    yield (*head, None), 0
                elif self.rows == "texts" and head[3] is None or self.rows == "pages" and head[3] != "html":
                    continue
                elif self.rows != "chunks" and i.file_size > self.limit[head[3]]:
                    yield (*head, f"over the limit of {self.limit[head[3]]} bytes"), 0
                else:
                    try:
                        for more, size in self._opened(z, i):
                            yield (*head, None, *more), size
                    except _BROKEN as e:
                        yield (*head, f"broken entry: {type(e).__name__}"), 0

    def _opened(self, z: zipfile.ZipFile, i: zipfile.ZipInfo) -> Iterator[tuple[tuple, int]]:
        if self.rows == "texts":
            text = z.read(i).decode("utf-8", "replace")
            yield (text,), len(text)
            return
        with z.open(i) as stream:
            chunks = iter(lambda: stream.read(self.chunk), b"")
            if self.rows == "chunks":
                for k, data in enumerate(chunks):
                    yield (k, data), len(data)
            else:
                yield from html_records.streamed(chunks)

"""Pages of a transfer and changes of a snapshot table as data sources, in batches and as streams that go on where they stopped.

Both read whole files by Arrow in the executors: a partition is a file of pages, or
of a change. Which files there are the driver's side lists through Arrow's file
systems (local, HDFS, object stores).
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .pages import PER_FILE, WIRE

PAGED = T.StructType([*WIRE.fields, T.StructField("page", T.LongType())])
NOTHING = "__HIVE_DEFAULT_PARTITION__"


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Pages, Changes):
        spark.dataSource.register(source)


def pages(spark: SparkSession, folder: str, session: str | None = None, first: int = 0) -> DataFrame:
    """Wire records with their page; filters on session and page choose the files that are opened."""
    register(spark)
    rows = spark.read.format(Pages.name()).option("path", folder).load()
    rows = rows if session is None else rows.where(rows["transfer_session_id"] == session)
    return rows.where(rows["page"] >= first) if first else rows


def stream_session(spark: SparkSession, folder: str, session: str, first: int = 0, per_file: int = PER_FILE) -> DataFrame:
    """The pages of one transfer as a stream, in their order as they come; its offset is the page that it goes on from."""
    register(spark)
    return spark.readStream.format(Pages.name()).option("path", folder).option("session", session).option("first", first).option("perFile", per_file).load()


def changes(spark: SparkSession, root: str, table: str, after: int = 0, until: int | None = None) -> DataFrame:
    """Rows that snapshot versions after one brought to a table, with ``_version``, and ``_whole`` if that version has no others.

    Of a key that several versions changed there is a row for each. What compaction
    wrote again isn't new.
    """
    register(spark)
    found = spark.read.format(Changes.name()).option("path", root).option("table", table).option("after", after)
    return (found if until is None else found.option("until", until)).load()


def stream_changes(spark: SparkSession, root: str, table: str, after: int = 0) -> DataFrame:
    """As ``changes``, each version once as it is committed; its offset is the version."""
    register(spark)
    return spark.readStream.format(Changes.name()).option("path", root).option("table", table).option("after", after).load()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _names(system: fs.FileSystem, folder: str, files: bool = False) -> list[str]:
    """What a folder holds, without hidden entries; none if there is no folder."""
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name[0] not in "._" and f.is_file == files)


#: Small files that one task reads, at most so many and so many bytes together; a larger file has a task of its own.
FILES, TOGETHER = 64, 8 << 20


@dataclass
class PageFiles(InputPartition):
    paths: list[str]
    first: int


def _together(files: Iterator[tuple[str, int]], first: int) -> list[InputPartition]:
    """Files (path, bytes) in their order, small ones in one partition: a transfer of many files isn't as many tasks."""
    out, room = [], 0
    for path, size in files:
        if not out or size > room or len(out[-1].paths) >= FILES:
            out.append(PageFiles([], first))
            room = TOGETHER
        out[-1].paths.append(path)
        room -= size
    return out


def _page_files(path: str, session: str | None, first: int, end: int | None = None) -> Iterator[tuple[int, str, int]]:
    """(first page in it, path, bytes) of the files that hold pages from ``first`` on and before ``end``."""
    system, root = _open(path)
    for folder in _names(system, root):
        if not folder.startswith("session=") or session not in (None, unquote(folder.removeprefix("session="))):
            continue
        starts = sorted(int(name.removeprefix("start=")) for name in _names(system, f"{root}/{folder}") if name.startswith("start="))
        for start, after in zip(starts, [*starts[1:], None], strict=True):
            if (after is None or after > first) and (end is None or start < end):
                part = f"{folder}/start={start}"
                found = system.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True))
                yield from ((start, f"{part}/{f.base_name}", f.size or 0) for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name[0] not in "._")


def _read_pages(path: str, schema: T.StructType, part: PageFiles) -> Iterator[pa.RecordBatch]:
    """Records of files from a page on, file by file. A file is parsed at once; ``write_pages`` bounds what it holds."""
    system, root = _open(path)
    for file in part.paths:
        yield from _read_page_file(system, f"{root}/{file}", schema, part.first)


def _read_page_file(system: fs.FileSystem, path: str, schema: T.StructType, first: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc
    from pyarrow import json as lines

    with system.open_input_stream(path, compression=None) as file:
        content = gzip.decompress(file.read())
    if not content:
        return
    arrow = to_arrow_schema(schema)
    whole = lines.read_json(pa.BufferReader(content), lines.ReadOptions(block_size=len(content) + 1), lines.ParseOptions(explicit_schema=arrow, unexpected_field_behavior="ignore"))
    table = whole.select(arrow.names).cast(arrow)
    yield from table.filter(pc.greater_equal(table["page"], first)).to_batches()


class Pages(DataSource):
    """An exchange folder (see sources.pages). Options: path, session, first (page), perFile (pages that the sender puts in a file)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def schema(self) -> T.StructType:
        return PAGED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagesReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return PagesStream(self.options, schema)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.rows = options["path"], schema
        self.session, self.first = options.get("session"), int(options.get("first", 0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Session and first page choose files; Spark still checks every row."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("transfer_session_id",):
                self.session = f.value
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("page",):
                self.first = max(self.first, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        return _together(((file, size) for _, file, size in _page_files(self.path, self.session, self.first)), self.first)

    def read(self, partition: PageFiles | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # Spark asks once with none where there are no partitions
            yield from _read_pages(self.path, self.rows, partition)


class PagesStream(DataSourceStreamReader):
    """Files of one session in page order: a file that comes before those in front of it waits for them."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.rows, self.session = options["path"], schema, options["session"]
        self.first, self.per_file = int(options.get("first", 0)), int(options.get("perFile", PER_FILE))

    def initialOffset(self) -> dict:
        return {"page": self.first}

    def latestOffset(self) -> dict:
        """The page after the last file that has come without a gap before it."""
        page = self.first - self.first % self.per_file
        starts = [start for start, _, _ in _page_files(self.path, self.session, page)]
        if any(start % self.per_file for start in starts):
            raise ValueError(f"files of this session don't hold {self.per_file} pages each (option perFile)")
        there = set(starts)
        while page in there:
            page += self.per_file
        return {"page": max(page, self.first)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _together(((file, size) for _, file, size in _page_files(self.path, self.session, start["page"], end["page"])), start["page"])

    def read(self, partition: PageFiles) -> Iterator[pa.RecordBatch]:
        yield from _read_pages(self.path, self.rows, partition)


@dataclass
class ChangeFile(InputPartition):
    path: str
    version: int
    whole: bool
    placed: dict[str, str | None]


def _text(system: fs.FileSystem, path: str) -> str:
    with system.open_input_stream(path) as file:
        return file.read().decode()


def _manifest(path: str, version: int) -> dict:
    system, root = _open(path)
    try:
        folder = _text(system, f"{root}/_commits/{version:08d}").strip()
        return json.loads(_text(system, f"{root}/{folder}/manifest.json"))
    except FileNotFoundError:
        raise ValueError(f"version {version} isn't there any more; take the table whole and go on from its version") from None


def _versions(path: str) -> list[int]:
    system, root = _open(path)
    return sorted(int(name) for name in _names(system, f"{root}/_commits", True) if name.isdigit())


def _files(system: fs.FileSystem, root: str, path: str) -> Iterator[tuple[str, dict[str, str | None]]]:
    """(file, values of its directory columns) of a part."""
    for f in system.get_file_info(fs.FileSelector(f"{root}/{path}", recursive=True)):
        if f.is_file and f.base_name[0] not in "._":
            inner = f.path.rpartition(f"/{path}/")[2]
            pairs = [d.split("=", 1) for d in inner.split("/")[:-1]]
            yield f"{path}/{inner}", {unquote(k): None if v == NOTHING else unquote(v) for k, v in pairs}


def _change_files(path: str, table: str, after: int, until: int) -> Iterator[ChangeFile]:
    system, root = _open(path)
    known = {p["path"] for p in _manifest(path, after).get(table, {"parts": []})["parts"]} if after else set()
    for version in range(after + 1, until + 1):
        parts = _manifest(path, version).get(table, {"parts": []})["parts"]
        for part in parts:
            if part["path"] not in known and not part.get("rewritten"):
                yield from (ChangeFile(file, version, "key" not in part, placed) for file, placed in _files(system, root, part["path"]))
        known = {p["path"] for p in parts}


def _read_changes(path: str, schema: T.StructType, part: ChangeFile) -> Iterator[pa.RecordBatch]:
    from pyarrow import parquet

    system, root = _open(path)
    arrow = to_arrow_schema(schema)
    with system.open_input_file(f"{root}/{part.path}") as file:
        for batch in parquet.ParquetFile(file).iter_batches():
            same = lambda value, kind: pa.array([value] * batch.num_rows, pa.string() if value is None or isinstance(value, str) else None).cast(kind)  # noqa: B023, E731
            extra = {"_version": part.version, "_whole": part.whole} | part.placed
            columns = [same(extra[f.name], f.type) if f.name in extra else batch.column(f.name).cast(f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)


class Changes(DataSource):
    """Changes of a table of snapshots (see sources.snapshots). Options: path, table, after and until (versions)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_changes"

    def schema(self) -> T.StructType:
        path, table = self.options["path"], self.options["table"]
        if not (there := _versions(path)) or table not in (manifest := _manifest(path, there[-1])):
            raise ValueError(f"there is no table {table} at {path}")
        rows = T.StructType.fromJson(manifest[table]["schema"])
        return T.StructType([*(T.StructField(f.name, f.dataType) for f in rows), T.StructField("_version", T.LongType()), T.StructField("_whole", T.BooleanType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChangesReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ChangesStream(self.options, schema)


class ChangesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.rows = options["path"], options["table"], schema
        self.after, self.until = int(options.get("after", 0)), options.get("until")

    def partitions(self) -> list[InputPartition]:
        until = max(_versions(self.path), default=0) if self.until is None else int(self.until)
        return list(_change_files(self.path, self.table, self.after, until))

    def read(self, partition: ChangeFile | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from _read_changes(self.path, self.rows, partition)


class ChangesStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.rows, self.after = options["path"], options["table"], schema, int(options.get("after", 0))

    def initialOffset(self) -> dict:
        return {"version": self.after}

    def latestOffset(self) -> dict:
        return {"version": max([self.after, *_versions(self.path)])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return list(_change_files(self.path, self.table, start["version"], end["version"]))

    def read(self, partition: ChangeFile) -> Iterator[pa.RecordBatch]:
        yield from _read_changes(self.path, self.rows, partition)

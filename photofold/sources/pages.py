"""A media listing that is handed out in pages, as a Spark data source.

A page has so many entries after a cursor, in order of time and id, an end cursor and whether more follow. A client says how the listing
falls apart into ranges of cursors, which are read side by side, each page by page; a stream's offset is the cursor it has come to.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from photofold.schemas import MEDIA_LISTING

#: Fixed value: entries of one page.
PAGE_ROWS = 100
ORDER = ("creation_time", "asset_id")

#: A place between two entries: time and id of the one before it. None is the beginning.
Cursor = tuple[int, str] | None


@dataclass(frozen=True)
class Page:
    entries: pa.Table
    end_cursor: Cursor
    has_next_page: bool


class PagedListing(Protocol):
    """What a client has to offer; it travels to the tasks."""

    def newest(self) -> Cursor: ...

    def ranges(self, after: Cursor, until: Cursor) -> Sequence[tuple[Cursor, Cursor, str]]:
        """Disjoint ranges (after, until] that together make up the whole one, and a hint for ``page``."""

    def page(self, after: Cursor, until: Cursor, hint: str, first: int) -> Page: ...


#: Entries without a time come first.
NO_TIME = -(1 << 63)
#: Fixed value: entries that a task hands on at once, in whole pages.
BATCH_ROWS = 10_000


def _in_order(rows: pa.Table) -> pa.Table:
    """Sorted rows in one piece, with the time of the order in ``_time``."""
    timed = rows.append_column("_time", pc.fill_null(rows["creation_time"], NO_TIME))
    return timed.sort_by([("_time", "ascending"), ("asset_id", "ascending")]).combine_chunks()


def _cursor_at(rows: pa.Table, place: int) -> tuple[int, str]:
    return rows["_time"][place].as_py(), rows["asset_id"][place].as_py()


class FolderListing:
    """A listing in a folder of Parquet files, each of which covers some range of times; new ones may be added.

    The folder may be anywhere that pyarrow's file systems reach. What a file covers is read from its footer.
    """

    def __init__(self, path: str):
        self.path = path
        self._open: tuple[str, pa.Table] | None = None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_open": None}

    def _files(self) -> list[str]:
        import pyarrow.fs

        system, root = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        self._system = system
        return sorted(f.path for f in found if f.path.endswith(".parquet") and "/_" not in f.path)

    def _sorted(self, file: str) -> pa.Table:
        """The entries of a file in order; the last one opened is kept, since its pages are asked for one after the other."""
        import pyarrow.parquet as pq

        if self._open is None or self._open[0] != file:
            self._files()
            self._open = (file, _in_order(pq.read_table(file, filesystem=self._system, partitioning=None)))
        return self._open[1]

    def _times(self, file: str) -> list[tuple[int, int]]:
        """First and last time of each row group that has rows, as far as the footer tells; what it leaves open is as wide as can be."""
        import pyarrow.parquet as pq

        with pq.ParquetFile(file, filesystem=self._system) as opened:
            footer = opened.metadata
        column = footer.schema.to_arrow_schema().get_field_index("creation_time")
        spans = []
        for k in range(footer.num_row_groups):
            group = footer.row_group(k)
            if not group.num_rows:
                continue
            known = group.column(column).statistics
            if known is None or not known.has_null_count or not (known.has_min_max or known.null_count == group.num_rows):
                spans.append((NO_TIME, -NO_TIME - 1))
            elif known.null_count == group.num_rows:
                spans.append((NO_TIME, NO_TIME))
            else:
                spans.append((NO_TIME if known.null_count else known.min, known.max))
        return spans

    def _last(self, file: str, group: int) -> Cursor:
        """The last cursor of a row group, from its sort columns alone."""
        import pyarrow.parquet as pq

        with pq.ParquetFile(file, filesystem=self._system) as opened:
            rows = opened.read_row_group(group, columns=list(ORDER))
        if not len(rows):
            return None
        rows = rows.append_column("_time", pc.fill_null(rows["creation_time"], NO_TIME))
        time = pc.max(rows["_time"]).as_py()
        return time, pc.max(rows.filter(pc.equal(rows["_time"], time))["asset_id"]).as_py()

    def newest(self) -> Cursor:
        """One row group after the other is read, those with the last times first, until the others are older."""
        groups = [(last, f, k) for f in self._files() for k, (_, last) in enumerate(self._times(f))]
        newest = None
        for last, file, k in sorted(groups, reverse=True):
            if newest is not None and last < newest[0]:
                break
            newest = max((c for c in (newest, self._last(file, k)) if c is not None), default=None)
        return newest

    def ranges(self, after: Cursor, until: Cursor) -> list[tuple[Cursor, Cursor, str]]:
        """A range for each file that may have entries there."""
        low, high = NO_TIME if after is None else after[0], None if until is None else until[0]
        found = [(f, self._times(f)) for f in self._files()]
        return [(after, until, f) for f, spans in found if any(last >= low and (high is None or first <= high) for first, last in spans)]

    def page(self, after: Cursor, until: Cursor, hint: str, first: int) -> Page:
        rows = self._sorted(hint)
        low, high = 0 if after is None else _place(rows, after), len(rows) if until is None else _place(rows, until)
        stop = max(low, min(low + first, high))
        taken = rows.slice(low, stop - low)
        return Page(taken, _cursor_at(rows, stop - 1) if stop > low else after, stop < high)


def _place(rows: pa.Table, cursor: tuple[int, str]) -> int:
    """How many of the sorted entries lie up to the cursor, by halving."""
    time, asset = rows["_time"], rows["asset_id"]
    return bisect_right(range(len(rows)), cursor, key=lambda k: (time[k].as_py(), asset[k].as_py()))


@dataclass
class _Range(InputPartition):
    after: Cursor
    until: Cursor
    hint: str


def _entries(client: PagedListing, part: _Range, rows: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    cursor, more, pages, held = part.after, True, [], 0
    while more:
        page = client.page(cursor, part.until, part.hint, rows)
        pages.append(page.entries.select(names))
        held += len(page.entries)
        cursor, more = page.end_cursor, page.has_next_page
        if held >= BATCH_ROWS or not more:
            yield from pa.concat_tables(pages).combine_chunks().to_batches()
            pages, held = [], 0


class _Batch(DataSourceReader):
    def __init__(self, client: PagedListing, rows: int, names: list[str]):
        self.client, self.rows, self.names = client, rows, names

    def partitions(self) -> list[InputPartition]:
        return [_Range(*r) for r in self.client.ranges(None, self.client.newest())]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _entries(self.client, partition, self.rows, self.names)


class _Stream(DataSourceStreamReader):
    def __init__(self, client: PagedListing, rows: int, names: list[str]):
        self.client, self.rows, self.names = client, rows, names

    @staticmethod
    def _offset(cursor: Cursor) -> dict:
        return {"time": None if cursor is None else cursor[0], "asset_id": None if cursor is None else cursor[1]}

    @staticmethod
    def _cursor(offset: dict) -> Cursor:
        return None if offset["time"] is None else (offset["time"], offset["asset_id"])

    def initialOffset(self) -> dict:
        return self._offset(None)

    def latestOffset(self) -> dict:
        return self._offset(self.client.newest())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, until = self._cursor(start), self._cursor(end)
        return [] if until is None or after == until else [_Range(*r) for r in self.client.ranges(after, until)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _entries(self.client, partition, self.rows, self.names)


def register_listing(spark: SparkSession, name: str, client: PagedListing, page_rows: int = PAGE_ROWS, schema: str = MEDIA_LISTING) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read the client's listing.

    A stream goes on after the newest entry it has seen; entries that appear before that cursor later are left to a batch read.
    """
    names = [field.split()[0] for field in schema.split(", ")]

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Batch(client, page_rows, names)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(client, page_rows, names)

    spark.dataSource.register(Listing)

"""Data sources of their own: read-only SQLite tables by row ranges, and paged resources with delta tokens."""

from __future__ import annotations

import json
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SqliteTable(DataSource):
    """spark.read.format("sqlite_table").schema(...).option("path", ...).option("table", ...)

    The columns are the schema's; ``partitions`` row-id ranges are read side by side. The file is opened read-only, or
    copied to the task where only its own store reaches it.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(schema, self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.columns, self.path, self.table = schema.names, options["path"], options["table"]
        self.most = int(options.get("partitions", "4"))

    def _query(self, sql: str, *given) -> Iterator[tuple]:
        fs, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        with tempfile.NamedTemporaryFile(suffix=".sqlite") as own:
            if not isinstance(fs, pafs.LocalFileSystem):
                with fs.open_input_stream(path) as f:
                    shutil.copyfileobj(f, own)
                own.flush()
                path = own.name
            connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
            try:
                yield from connection.execute(sql, given)
            finally:
                connection.close()

    @staticmethod
    def _quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        ((low, high),) = self._query(f"SELECT min(rowid), max(rowid) FROM {self._quoted(self.table)}")
        if low is None:
            return []
        step = -(-(high - low + 1) // self.most)
        return [InputPartition((a, a + step)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fields = ", ".join(map(self._quoted, self.columns))
        yield from self._query(f"SELECT {fields} FROM {self._quoted(self.table)} WHERE rowid >= ? AND rowid < ?", *partition.value)


class PagedResource(DataSource):
    """spark.read.format("paged_resource").option("root", ...).option("resources", "a,b")

    A resource is a folder of JSON pages {"value": [...], "next": name or "delta": token}; it is followed from
    ``delta`` (option delta.<resource>) or from page-0.json. A page that is gone ({"gone": true}) starts the resource anew
    from its beginning. A row an item: (resource, id, body, removed), one more for the token to go on from.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_resource"

    def schema(self) -> str:
        return "resource string, id string, body string, removed boolean, delta string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.options["resources"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, root = pafs.FileSystem.from_uri(self.options["root"])
        resource, first = partition.value, "page-0.json"
        page = self.options.get(f"delta.{resource}".lower()) or self.options.get(f"delta.{resource}") or first
        rows: list[tuple] = []
        while page:
            with fs.open_input_stream(f"{root}/{resource}/{page}") as f:
                got = json.loads(f.read())
            if got.get("gone"):
                if page == first:
                    raise ValueError(f"{resource} has no beginning")
                rows, page = [], first
                continue
            rows += [(resource, str(v["id"]), json.dumps(v, sort_keys=True), bool(v.get("removed")), None) for v in got["value"]]
            page = got.get("next")
            if not page:
                rows.append((resource, None, None, None, got.get("delta")))
        yield from rows


def register(spark) -> None:
    for source in (SqliteTable, PagedResource):
        spark.dataSource.register(source)

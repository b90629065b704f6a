"""Pluggable event sources, and two of them as Spark data sources: lines of event files, and a crawl's capture spool.

``register(spark)`` makes them known: ``spark.read.format("event_lines").load(folder)`` and ``spark.read.format("capture_spool").option("table", "captures").load(file)``. Any other source is
a ``DataSource`` of one's own, or an ``EventSource``: whatever has ``records(spark)`` with ``ref`` and ``line``.
"""

from __future__ import annotations

import io
import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Tables of a capture spool and their columns.
SPOOL = {
    "captures": "row_id bigint, source_id string, final_url string, content_hash string, selection_key string, payload_json string",
    "unique_content_groups": "source_id string, content_hash string, identity string",
    "visited_urls": "url string",
    "sitemap_pages": "origin string, url string",
    "sitemap_origins": "origin string, page_count bigint",
}


def local(path: str) -> str:
    """A plain path of storage that every executor mounts."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def store(path: str):
    """The Arrow file system of a path and the path there: local or any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else (fs.LocalFileSystem(), local(path))


class EventSource(Protocol):
    """Anything that gives event lines with where they come from. Delivery may be at least once."""

    def records(self, spark: SparkSession) -> DataFrame: ...


class JsonLines:
    """The lines of text files."""

    def __init__(self, path: str) -> None:
        self.path = path

    def records(self, spark: SparkSession) -> DataFrame:
        from corpuslake.sources.batches import text_lines

        return text_lines(spark, self.path)


class PublishedEvents:
    """The event records of published batches below a folder."""

    def __init__(self, root: str) -> None:
        self.root = root

    def records(self, spark: SparkSession) -> DataFrame:
        from pyspark.sql import functions as F

        from corpuslake.sources.batches import published_batches, validate_batch

        out = None
        for folder in published_batches(spark, self.root):
            manifest, rows = validate_batch(spark, folder)
            x = rows.where("record_type = 'operational'").select(F.concat_ws(":", F.lit(manifest["batch_id"]), "record_id").alias("ref"), F.col("record_json").alias("line"))
            out = x if out is None else out.unionByName(x)
        return out if out is not None else spark.createDataFrame([], "ref string, line string")


class EventLines(DataSource):
    """``ref, line`` of the text files of a folder, a file to a task; blank lines left out."""

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "ref string, line string"

    def reader(self, schema) -> DataSourceReader:
        return EventLinesReader(self.options["path"])


class EventLinesReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        files, top = store(self.path)
        kind = files.get_file_info(top).type
        if kind == FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = sorted(x.path for x in files.get_file_info(FileSelector(top)) if x.type == FileType.File) if kind == FileType.Directory else [top]
        return [InputPartition(x) for x in names if os.path.basename(x)[0] not in "._"] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        if partition.value is not None:
            name = os.path.basename(partition.value)
            with io.TextIOWrapper(io.BufferedReader(store(self.path)[0].open_input_stream(partition.value), 1 << 20), encoding="utf-8") as f:
                for number, line in enumerate(f, 1):
                    if line.strip():
                        yield f"{name}:{number}", line.rstrip("\r\n")


class CaptureSpool(DataSource):
    """One table of a capture spool (an SQLite file on storage that the executors share), read only; captures come in ranges of row_id, a range to a task."""

    @classmethod
    def name(cls) -> str:
        return "capture_spool"

    def schema(self) -> str:
        return SPOOL[self.options.get("table", "captures")]

    def reader(self, schema) -> DataSourceReader:
        return SpoolReader(self.options["path"], self.options.get("table", "captures"), int(self.options.get("rows", "100000")))


class SpoolReader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int) -> None:
        self.path, self.table, self.rows = local(path), table, rows

    def open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        if self.table != "captures":
            return [InputPartition(None)]
        with self.open() as con:
            low, high = con.execute("SELECT min(row_id), max(row_id) FROM captures").fetchone()
        return [InputPartition((a, a + self.rows)) for a in range(low, high + 1, self.rows)] if low is not None else [InputPartition((0, 0))]

    def read(self, partition: InputPartition):
        names = ", ".join(c.split()[0] for c in SPOOL[self.table].split(", "))
        where = " WHERE row_id >= ? AND row_id < ? ORDER BY row_id" if partition.value is not None else ""
        with self.open() as con:
            yield from con.execute(f"SELECT {names} FROM {self.table}{where}", partition.value or ())


def register(spark: SparkSession) -> None:
    for source in (EventLines, CaptureSpool):
        spark.dataSource.register(source)

"""Zipped tab-separated exports as a Spark data source: a partition per archive, and archives of unwanted days never opened.

``exports`` reads them, or ``spark.read.format("zipped_exports")`` with the options ``first`` and ``last``. An archive's name begins with its day as yyyymmdd, and the options choose archives by it. They are options
and not pushed-down filters, as a reader that takes filters keeps them in PySpark 4.1: a frame that was filtered once gives a part of its rows when it is read whole afterwards. Rows of fewer than 61 columns are left out, and so are archives that aren't zip files; bytes that aren't UTF-8 become replacement characters.
Members are read as streams, so memory doesn't follow an archive's size. The folder may lie on any file system that Arrow opens by its URI.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = re.compile(r"(\d{8}).*\.zip$", re.I)
# Places of the day and the address in an export's row, and its least number of columns.
DAY, URL, COLUMNS = 1, 60, 61


@dataclass
class Archive(InputPartition):
    path: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def day_of(text: str) -> date | None:
    try:
        return datetime.strptime(text, "%Y%m%d").date()
    except ValueError:
        return None


class ExportReader(DataSourceReader):
    def __init__(self, path: str, batch: int, first: date, last: date):
        self.path, self.batch, self.first, self.last = path, batch, first, last

    def partitions(self) -> list[Archive]:
        system, root = opened(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            m = NAME.match(info.base_name)
            day = day_of(m[1]) if m and info.is_file else None
            if day and self.first <= day <= self.last:
                found.append(Archive(info.path))
        return sorted(found, key=lambda a: a.path) or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f:
            try:
                archive = zipfile.ZipFile(f)
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for files shorter than a zip file's end
                return
            for member in archive.infolist():
                days, urls = [], []
                with archive.open(member) as raw:
                    for line in io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n"):
                        c = line.rstrip("\r\n").split("\t")
                        if len(c) >= COLUMNS:
                            days.append(day_of(c[DAY]))
                            urls.append(c[URL])
                        if len(urls) >= self.batch:
                            yield self.rows(days, urls, partition.path)
                            days, urls = [], []
                if urls:
                    yield self.rows(days, urls, partition.path)

    @staticmethod
    def rows(days: list[date | None], urls: list[str], path: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(days, pa.date32()), pa.array(urls, pa.string()), pa.array([path.rsplit("/", 1)[-1]] * len(urls), pa.string())], names=["day", "url", "archive"])


class ZippedExports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_exports"

    def schema(self) -> str:
        return "day date, url string, archive string"

    def reader(self, schema) -> ExportReader:
        day = lambda name, otherwise: date.fromisoformat(self.options[name]) if name in self.options else otherwise
        return ExportReader(self.options["path"], int(self.options.get("batch", 10_000)), day("first", date.min), day("last", date.max))


def exports(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """(day, url, archive) of the archives under ``path`` named for days from ``first`` to ``last``, both included; without a bound, of all."""
    spark.dataSource.register(ZippedExports)
    reader = spark.read.format(ZippedExports.name())
    for name, day in (("first", first), ("last", last)):
        reader = reader.option(name, day.isoformat()) if day else reader
    return reader.load(path)

"""A stream over numbered pages that a collector lands, one folder (page=0, page=1, ...) after the other.

The stream's offset is the number of pages read, kept in the query's checkpoint, so a run that was stopped goes on with the
next page. A page is read in a task, line by line; the driver only looks which pages are there. A page counts as landed
once its folder has a file named _SUCCESS or once a later page is there; pages are read in order, none is passed over."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page long, place long, body string"


def _at(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path)


def landed(path: str) -> int:
    """How many pages, from 0 on, are there without a gap."""
    import pyarrow.fs as pafs

    fs, place = _at(path)
    found = fs.get_file_info(pafs.FileSelector(place, allow_not_found=True))
    there = {int(f.base_name[5:]) for f in found if f.type == pafs.FileType.Directory and f.base_name[:5] == "page=" and f.base_name[5:].isdigit()}
    n = 0
    while n in there:
        n += 1
    if n and n == len(there):  # the last of all may still be written
        done = fs.get_file_info(f"{place}/page={n - 1}/_SUCCESS").type == pafs.FileType.File
        all_done = fs.get_file_info(f"{place}/_SUCCESS").type == pafs.FileType.File
        n -= not (done or all_done)
    return n


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


def read_page(path: str, number: int) -> Iterator[tuple[int, int, str]]:
    """The lines of a page's files, numbered in the order of the files' names."""
    import io

    import pyarrow.fs as pafs

    fs, place = _at(path)
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{place}/page={number}")) if f.type == pafs.FileType.File and f.base_name[:1] not in "._")
    at = 0
    for name in files:
        with fs.open_input_stream(name) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8", newline="\n") as lines:
            for line in lines:
                yield number, at, line.rstrip("\n")
                at += 1


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": landed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in range(start["pages"], end["pages"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        return read_page(self.path, partition.number)


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        return [Page(n) for n in range(landed(self.path))]

    def read(self, partition: Page) -> Iterator[tuple]:
        return read_page(self.path, partition.number)


class LandedPages(DataSource):
    """spark.dataSource.register(LandedPages); spark.readStream.format("landed_pages").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

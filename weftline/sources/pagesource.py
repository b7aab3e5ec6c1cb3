"""A data source of numbered pages: batch, and as a stream that goes on where it ended.

    spark.dataSource.register(PageSource)
    spark.read.format("pages").option("fetch", "my.module:page").option("last", "40").load()
    spark.readStream.format("pages").option("fetch", "my.module:page").option("newest", "my.module:newest").load()

`fetch` names a function of a page number that gives its text, or None where there is no such page; executors import
and call it, one task for each run of `pages_per_task` pages. A page that fails is tried again with a growing wait; one that cannot
be had is a row with its error, and the rest goes on. `newest` names a function that gives the number of the last
page now; the stream's offset is the last page read, so a restart asks for later ones only. `folder`, in place of
both, reads files named 1.html and on from a folder that all machines see.
"""

from __future__ import annotations

import importlib
import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from weftline.sources.fetch import ATTEMPTS, MOST_PAGES, WAIT_S, FetchError, with_retries

SCHEMA = "page int, html string, error string"


def _named(path: str) -> Callable:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _file(folder: str, page: int) -> str | None:
    try:
        with open(os.path.join(folder, f"{page}.html"), encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError:
        return None


class PageRange(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Pages:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.fetch, self.newest = (options.get(k) for k in ("folder", "fetch", "newest"))
        if (self.folder is None) == (self.fetch is None):
            raise ValueError("give one of the options folder and fetch")
        self.first, self.per_task = int(options.get("first", 1)), int(options.get("pages_per_task", 5))
        self.attempts, self.wait_s = int(options.get("attempts", ATTEMPTS)), float(options.get("wait_s", WAIT_S))
        self.given_last = int(options["last"]) if "last" in options else None

    def last(self) -> int:
        if self.given_last is not None:
            return self.given_last
        if self.folder is not None:
            return max([int(m[1]) for x in os.listdir(self.folder) if (m := re.fullmatch(r"(\d+)\.html", x))], default=0)
        return int(_named(self.newest)()) if self.newest else self.first - 1 + MOST_PAGES

    def ranges(self, first: int, last: int) -> list[PageRange]:
        return [PageRange(a, min(a + self.per_task - 1, last)) for a in range(first, last + 1, self.per_task)]

    def rows(self, part: PageRange) -> Iterator[tuple]:
        get = (lambda url: _file(self.folder, int(url))) if self.folder is not None else (lambda url, f=_named(self.fetch): f(int(url)))
        for page in range(part.first, part.last + 1):
            try:
                html = with_retries(get, str(page), self.attempts, self.wait_s)
                if html is not None:
                    yield page, html, None
            except FetchError as e:
                yield page, None, str(e)


class _Batch(DataSourceReader):
    def __init__(self, pages: _Pages) -> None:
        self.pages = pages

    def partitions(self) -> list[PageRange]:
        return self.pages.ranges(self.pages.first, self.pages.last()) or [PageRange(1, 0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, pages: _Pages) -> None:
        self.pages = pages

    def initialOffset(self) -> dict:
        return {"page": self.pages.first - 1}

    def latestOffset(self) -> dict:
        return {"page": max(self.pages.last(), self.pages.first - 1)}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        return self.pages.ranges(start["page"] + 1, end["page"])

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Pages(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Pages(dict(self.options)))

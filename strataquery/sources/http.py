"""A paged HTTP source of candidates for backfills: ranges of offsets are read in parallel, and a stream goes on from its last offset.

The service answers GET <url>?offset=<n>&limit=<m> with {"total": <rows>, "items": [...]}. Options: url; page (rows of a request, 100); start (first offset, 0);
partitions (ranges of a batch read, 8); timeout (seconds, 30). Columns: offset long, body string (the item as JSON).
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "offset long, body string"


class OffsetRange(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class _Pages:
    def __init__(self, options: dict):
        self.url, self.page, self.start = options["url"], int(options.get("page", 100)), int(options.get("start", 0))
        self.parts, self.timeout = int(options.get("partitions", 8)), float(options.get("timeout", 30))
        if self.page < 1 or self.parts < 1:
            raise ValueError("page and partitions must be at least 1")

    def get(self, offset: int, limit: int) -> dict:
        mark = "&" if "?" in self.url else "?"
        with urllib.request.urlopen(f"{self.url}{mark}{urllib.parse.urlencode({'offset': offset, 'limit': limit})}", timeout=self.timeout) as reply:
            return json.loads(reply.read())

    def total(self) -> int:
        return int(self.get(0, 0)["total"])

    def ranges(self, begin: int, end: int) -> list[OffsetRange]:
        """Whole pages dealt over the partitions."""
        pages = max(0, -(-(end - begin) // self.page))
        step = max(1, -(-pages // self.parts)) * self.page
        return [OffsetRange(at, min(at + step, end)) for at in range(begin, end, step)]

    def rows(self, part: OffsetRange) -> Iterator[tuple]:
        at = part.begin
        while at < part.end:
            items = self.get(at, min(self.page, part.end - at))["items"]
            if not items:
                raise OSError(f"no items at offset {at}, though the range ends at {part.end}")
            for item in items[: part.end - at]:
                yield at, json.dumps(item, ensure_ascii=False, sort_keys=True)
                at += 1


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self) -> list[OffsetRange]:
        return self.pages.ranges(self.pages.start, self.pages.total()) or [OffsetRange(0, 0)]

    def read(self, partition: OffsetRange) -> Iterator[tuple]:
        return self.pages.rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def initialOffset(self) -> dict:
        return {"offset": self.pages.start}

    def latestOffset(self) -> dict:
        return {"offset": max(self.pages.total(), self.pages.start)}

    def partitions(self, start: dict, end: dict) -> list[OffsetRange]:
        return self.pages.ranges(start["offset"], end["offset"])

    def read(self, partition: OffsetRange) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes format("http_pages") known to the session."""
    spark.dataSource.register(HttpPages)

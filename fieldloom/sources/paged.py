"""A batch data source over paged services; pages are fetched by executors.

The fetcher is a function (page number) -> (rows, whether there are more), so tests and offline runs
need no network. Page counts and row counts have limits that fail instead of cutting off.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def with_retries(call: Callable[[], object], retries: int = 2, first_wait: float = 0.75) -> object:
    """The call's result; waits double from try to try, and the last error is raised."""
    for n in range(retries + 1):
        try:
            return call()
        except OSError:
            if n == retries:
                raise
            time.sleep(first_wait * 2**n)
    raise AssertionError


class Pages(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


def source(name_: str, schema_: str, fetch: Callable[[int], tuple[list[tuple], bool]], most_pages: int = 100, lanes: int = 4) -> type[DataSource]:
    """A data source whose lane k reads the pages k, k + lanes, ... until one says that no more follow."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [Pages(k, lanes) for k in range(lanes)]

        def read(self, partition: Pages) -> Iterator[tuple]:
            page = partition.first
            while True:
                if page >= most_pages:
                    raise ValueError(f"more than {most_pages} pages")
                rows, more = with_retries(lambda: fetch(page))
                yield from rows
                if not more:
                    return
                page += partition.step

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    return Paged


def read(spark: SparkSession, kind: type[DataSource]) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).load()

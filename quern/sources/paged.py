"""Paged sources as Spark data sources: one partition per page, filters and columns pushed to the pages.

Live services are out of reach here and need credentials; a source reads pages
of recorded JSON lines (``page-0001.jsonl`` and so on, a common layout for
exports). A service's client is a subclass that overrides ``fetch``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        super().__init__(number)
        self.number = number


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class PagedReader(DataSourceReader):
    """Pages 1 to ``pages`` of a folder; the first that is missing ends the source."""

    def __init__(self, schema, options: dict) -> None:  # noqa: ANN001
        self.names = [f.name for f in schema.fields]
        self.options = options
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(1, int(self.options.get("pages", "1")) + 1)]

    def fetch(self, number: int) -> Iterator[dict]:
        import os

        path = os.path.join(self.options["path"], f"page-{number:04d}.jsonl")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as lines:
                yield from map(json.loads, lines)

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in self.fetch(partition.number):
            values = [row.get(f.attribute[0]) for f in self.filters]
            if all(v is not None and _TESTS[type(f)](v, f.value) for v, f in zip(values, self.filters, strict=True)):
                yield tuple(row.get(n) for n in self.names)


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("path", ...).option("pages", n)``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options.get("schema", "id string")

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known; filters reach a Python source only where this setting is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def paged(spark: SparkSession, path: str, schema: str, pages: int) -> DataFrame:
    register(spark)
    return spark.read.format("paged").schema(schema).option("path", path).option("pages", str(pages)).load()


def since(rows: DataFrame, column: str, start: str | None, end: str | None = None) -> DataFrame:
    """An incremental window of a source by time; the filter reaches the scan."""
    out = rows
    if start is not None:
        out = out.where(F.col(column) > F.lit(start).cast(rows.schema[column].dataType))
    if end is not None:
        out = out.where(F.col(column) <= F.lit(end).cast(rows.schema[column].dataType))
    return out

"""Cursor sources: exports that grow, read as a stream from where the last run ended.

A service lists records by the time they were made. The source's offset is such a
time: a run reads what was made after the start's offset up to the newest there is,
a page a partition; pages that end before or begin after that are not opened. The
stream's checkpoint keeps the offset, so a run that comes again reads on, and one
that broke off reads the same records again (``start`` and ``end`` are in its log).

A live service's client is a subclass that overrides ``pages`` and ``fetch``. Here
both read a folder of JSON lines (``since=<first>_until=<last>.jsonl``) that driver and
executors share.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class CursorPage(InputPartition):
    def __init__(self, name: str, after: int, until: int) -> None:
        super().__init__(name)
        self.name, self.after, self.until = name, after, until


class CursorClient:
    """Pages with the times of their first and last record, and the records of a page."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].removeprefix("file://").removeprefix("file:")
        self.time = options.get("time", "created")

    def pages(self) -> list[tuple[str, int, int]]:
        names = sorted(x for x in os.listdir(self.folder) if x.endswith(".jsonl")) if os.path.isdir(self.folder) else []
        return [(n, *(int(x.split("=")[1]) for x in n.removesuffix(".jsonl").split("_"))) for n in names]

    def fetch(self, name: str) -> Iterator[dict]:
        with open(os.path.join(self.folder, name), encoding="utf-8") as lines:
            yield from map(json.loads, lines)


def _read(client: CursorClient, names: list[str], page: CursorPage | None) -> Iterator[tuple]:
    for row in client.fetch(page.name) if page else ():  # without partitions there is still one task
        at = row.get(client.time)
        if at is not None and page.after < at <= page.until:
            yield tuple(row.get(n) for n in names)


class CursorStream(DataSourceStreamReader):
    def __init__(self, schema, options: dict) -> None:  # noqa: ANN001
        self.names, self.client, self.first = [f.name for f in schema.fields], CursorClient(options), int(options.get("after", "-1"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max([self.first, *(last for _, _, last in self.client.pages())])}

    def partitions(self, start: dict, end: dict) -> list[CursorPage]:
        a, b = start["after"], end["after"]
        return [CursorPage(n, a, b) for n, first, last in self.client.pages() if last > a and first <= b]

    def read(self, partition: CursorPage) -> Iterator[tuple]:
        return _read(self.client, self.names, partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: an export keeps its records."""


class CursorBatch(DataSourceReader):
    """The same window once: ``after`` and ``until`` are options, and pages outside are no partitions."""

    def __init__(self, schema, options: dict) -> None:  # noqa: ANN001
        self.names, self.client = [f.name for f in schema.fields], CursorClient(options)
        self.after, self.until = int(options.get("after", "-1")), int(options.get("until", str(2**62)))

    def partitions(self) -> list[CursorPage]:
        return [CursorPage(n, self.after, self.until) for n, first, last in self.client.pages() if last > self.after and first <= self.until]

    def read(self, partition: CursorPage) -> Iterator[tuple]:
        return _read(self.client, self.names, partition)


class CursorSource(DataSource):
    """``format("cursor")`` with ``path``, ``time`` (the column of record times), ``after`` and, not in streams, ``until``."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return "id string"

    def reader(self, schema) -> CursorBatch:  # noqa: ANN001
        return CursorBatch(schema, self.options)

    def streamReader(self, schema) -> CursorStream:  # noqa: ANN001, N802
        return CursorStream(schema, self.options)


def window(spark: SparkSession, path: str, schema: str, time: str, after: int = -1, until: int = 2**62) -> DataFrame:
    spark.dataSource.register(CursorSource)
    return spark.read.format("cursor").schema(schema).option("path", path).option("time", time).option("after", str(after)).option("until", str(until)).load()


def pull(spark: SparkSession, path: str, schema: str, time: str, out: str, checkpoint: str, after: int = -1) -> None:
    """Takes records that no earlier run of this checkpoint took to the table at ``out``."""
    spark.dataSource.register(CursorSource)
    stream = spark.readStream.format("cursor").schema(schema).option("path", path).option("time", time).option("after", str(after)).load()
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def export(rows: DataFrame, path: str, time: str, page_rows: int = 10_000) -> None:
    """Records as pages of JSON lines, by time; each task writes its own pages."""
    folder = path.removeprefix("file://").removeprefix("file:")

    def write(part: Iterator) -> Iterator:
        os.makedirs(folder, exist_ok=True)

        def page(held: list[dict]) -> None:
            name = f"{folder}/since={held[0][time]}_until={held[-1][time]}"
            with open(f"{name}.tmp", "w", encoding="utf-8") as f:
                f.writelines(json.dumps(x, default=str) + "\n" for x in held)
            os.replace(f"{name}.tmp", f"{name}.jsonl")  # a page is there whole, and once, if a task runs again

        held: list[dict] = []
        for batch in part:
            for row in batch.to_pylist():
                if len(held) >= page_rows and row[time] != held[-1][time]:
                    page(held)
                    held = []
                held.append(row)
        if held:
            page(held)
        return iter(())

    rows.where(f"`{time}` IS NOT NULL").repartitionByRange(time).sortWithinPartitions(time).mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()

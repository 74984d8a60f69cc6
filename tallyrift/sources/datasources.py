"""Spark data sources for what is asked from a server: statistics by request, and a ledger of lines as a stream.

What asks is a function that is handed in and goes to the tasks; a source is registered under a name and read by
``spark.read.format(name)`` or ``spark.readStream.format(name)``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Lines of a ledger that a task asks for.
LINES = 1000
REQUEST = ("family", "year", "measure")


@dataclass
class Request(InputPartition):
    family: int
    year: int
    measure: int


class StatisticsReader(DataSourceReader):
    """A partition for each request; filters on what makes a request leave requests out."""

    def __init__(self, wanted: dict[str, Sequence[int]], ask: Callable[[dict], str]):
        self.wanted, self.ask = {k: list(dict.fromkeys(v)) for k, v in wanted.items()}, ask

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in REQUEST:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.wanted[column] = [v for v in self.wanted[column] if v in values]
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Request(f, y, m) for f in self.wanted["family"] for y in self.wanted["year"] for m in self.wanted["measure"]]

    def read(self, partition: Request) -> Iterator[tuple]:
        if partition is None:  # no requests at all
            return
        asked = {c: getattr(partition, c) for c in REQUEST}
        yield (*asked.values(), self.ask(asked))


def statistics(spark: SparkSession, ask: Callable[[dict], str], name: str = "statistics") -> None:
    """Register a source of (family, year, measure, html), an answer a request; ``ask`` gives the answer to a request.

    Options ``families``, ``years`` and ``measures`` are lists by commas. Filters on these columns by = and IN are pushed into
    the requests, where the session lets Python sources have them (``spark.sql.python.filterPushdown.enabled``).
    """
    class Statistics(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "family int, year int, measure int, html string"

        def reader(self, schema) -> DataSourceReader:
            listed = lambda option, usual: [int(x) for x in self.options.get(option, usual).split(",") if x.strip()]
            return StatisticsReader({"family": listed("families", ""), "year": listed("years", ""), "measure": listed("measures", "2")}, ask)

    spark.dataSource.register(Statistics)


@dataclass
class Lines(InputPartition):
    first: int
    upto: int


class LedgerReader(DataSourceStreamReader):
    """Offsets are numbers of lines; a task asks for some of those between two."""

    def __init__(self, length: Callable[[], int], lines: Callable[[int, int], Sequence[str]], key: str, many: int):
        self.length, self.lines, self.key, self.many = length, lines, key, many

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"line": self.length()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Lines(a, min(end["line"], a + self.many)) for a in range(start["line"], end["line"], self.many)]

    def read(self, partition: Lines) -> Iterator[tuple]:
        for n, text in enumerate(self.lines(partition.first, partition.upto), partition.first):
            try:
                row = json.loads(text)
                if isinstance(row, dict) and row.get(self.key) is not None:
                    yield n, str(row[self.key]), text
            except ValueError:  # a bad line is skipped
                continue


def ledger(spark: SparkSession, length: Callable[[], int], lines: Callable[[int, int], Sequence[str]], key: str = "id", name: str = "ledger", many: int = LINES) -> None:
    """Register a stream of (line, key, json) of a ledger that only grows: ``length`` gives how many lines it has, ``lines``
    those from one number up to another. Lines that are no objects or have no key are skipped."""
    class Ledger(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "line long, key string, json string"

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return LedgerReader(length, lines, key, many)

    spark.dataSource.register(Ledger)

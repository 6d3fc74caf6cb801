"""A data source over paged feature services, one partition for each range of offsets, or,
where the option ``total`` is not given, one that reads on until the service has no more.

``spark.dataSource.register(PagedFeatures)``, then
``spark.read.format("paged_features").schema(...).option("fetch", "module:function")``.
The function takes (offset, size, columns) and returns a list of dictionaries, or that list
and whether the service stopped at its transfer limit: then there is more, however short
the page.  Tests pass a local function, deployments one that asks their service.  Only the
columns of the schema are asked for.

``fetch`` may name several functions, separated by commas: where one fails, the next is
asked, ``attempts`` times around (4) with growing pauses of ``wait`` seconds (1.5).  With
the option ``where`` the functions take a fourth argument, a list of (column, operator,
value), and the service filters: what Spark pushes down there it does not check again.
Spark pushes only if ``spark.sql.python.filterPushdown.enabled`` is set.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

PAGE = 2000
#: Filters a service can take, by the operator it is told.
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "NAME string, STATE string, CITY string, X double, Y double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Filtering if self.options.get("where", "false").lower() == "true" else _Reader)(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.fetch, self.total = options["fetch"].split(","), int(options["total"]) if "total" in options else None
        self.page, self.columns = int(options.get("page", PAGE)), schema.fieldNames()
        self.attempts, self.wait = int(options.get("attempts", 4)), float(options.get("wait", 1.5))
        self.where: list[tuple] | None = None

    def partitions(self) -> list[InputPartition]:
        # how many rows a filter leaves, no total of the whole table tells
        if self.total is None or self.where:
            return [InputPartition(None)]
        return [InputPartition(offset) for offset in range(0, max(1, self.total), self.page)]

    def _ask(self, offset: int, size: int) -> tuple[list[dict], bool]:
        """One page, and whether the service stopped at its limit; every endpoint in turn."""
        failed: Exception | None = None
        for attempt in range(self.attempts):
            for name in self.fetch:
                module, _, function = name.strip().partition(":")
                try:
                    found = getattr(importlib.import_module(module), function)(offset, size, self.columns, *([] if self.where is None else [self.where]))
                    return found if isinstance(found, tuple) else (found, False)
                except (OSError, ValueError) as error:
                    failed = error
            time.sleep(self.wait * (attempt + 1) if attempt + 1 < self.attempts else 0)
        raise RuntimeError(f"no endpoint gave the page at {offset}: {failed}")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        offset = partition.value or 0
        end = None if partition.value is None else offset + self.page
        while end is None or offset < end:
            size = self.page if end is None else end - offset
            rows, limited = self._ask(offset, size)
            for row in rows:
                yield tuple(row.get(c) for c in self.columns)
            offset += len(rows)
            # a page that is not full is the last, unless the service says it was cut
            if not rows or not limited and len(rows) < size:
                return


class _Filtering(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.where = []
        for f in filters:
            if type(f) in OPERATORS and len(f.attribute) == 1:
                self.where.append((f.attribute[0], OPERATORS[type(f)], f.value))
            else:
                yield f

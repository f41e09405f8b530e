"""Searches as a data source: a partition for each query and page, and what goes wrong as a column.

    spark.dataSource.register(SearchSource)
    spark.read.format("veridex_search_pages").option("queries", "a\\nb").option("function", "module.search").load()

The function gets a query and a page's number, from 0, and returns or yields hits: dicts with the address under
``href``, ``link`` or ``url``, and a title. Hits without an address are left out. When it raises, the hits before stay and
a row with ``error`` follows, with neither address nor title: a search that fails halfway is a partial list, and other
searches go on. Options: ``pages`` (1), ``per_page`` (30), ``limit``, the hits of a query at most: pages beyond it are
never asked for.

Filters on ``query``, ``page`` and ``place`` are pushed into the source, where they leave out searches; set
spark.sql.python.filterPushdown.enabled. A filter on ``place`` is checked by Spark as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "query string, page int, place int, url string, title string, error string"


@dataclass
class Search(InputPartition):
    query: str
    page: int


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "veridex_search_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.queries = list(dict.fromkeys(q for q in options.get("queries", "").split("\n") if q))
        self.function, self.per_page = options["function"], int(options.get("per_page", 30))
        self.limit = int(options["limit"]) if "limit" in options else None
        #: Pages asked for, and the places of hits that are wanted at all.
        self.first_page, self.end_page, self.first_place, self.end_place = 0, int(options.get("pages", 1)), 0, self.limit

    def _narrow(self, column: str, low: int | None, end: int | None) -> None:
        if low is not None:
            setattr(self, f"first_{column}", max(getattr(self, f"first_{column}"), low))
        if end is not None:
            now = getattr(self, f"end_{column}")
            setattr(self, f"end_{column}", end if now is None else min(now, end))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column, value = f.attribute[0] if getattr(f, "attribute", None) else None, getattr(f, "value", None)
            if column == "query" and isinstance(f, EqualTo | In):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.queries = [q for q in self.queries if q in wanted]
                continue
            if column in ("page", "place") and isinstance(f, EqualTo | LessThan | LessThanOrEqual | GreaterThan | GreaterThanOrEqual):
                low = {EqualTo: 0, GreaterThan: 1, GreaterThanOrEqual: 0}.get(type(f))
                end = {EqualTo: 1, LessThan: 0, LessThanOrEqual: 1}.get(type(f))
                self._narrow(column, None if low is None else value + low, None if end is None else value + end)
                # a row with an error has no place, so Spark looks at places itself
                if column == "page":
                    continue
            yield f

    def partitions(self) -> list[Search]:
        end = self.end_page
        if self.end_place is not None:
            end = min(end, -(-self.end_place // self.per_page))
        begin = max(self.first_page, self.first_place // self.per_page)
        return [Search(q, p) for q in self.queries for p in range(begin, end)]

    def read(self, partition: Search) -> Iterator[tuple]:
        module, _, name = self.function.rpartition(".")
        place = partition.page * self.per_page
        try:
            for hit in getattr(import_module(module), name)(partition.query, partition.page):
                if (self.limit is not None and place >= self.limit) or place >= (partition.page + 1) * self.per_page:
                    return
                url = hit.get("href") or hit.get("link") or hit.get("url")
                if url:
                    yield partition.query, partition.page, place, url, hit.get("title") or "", None
                    place += 1
        except Exception as e:  # a search that fails is data here
            yield partition.query, partition.page, None, None, None, f"{type(e).__name__}: {e}"

"""A paged JSON source as a Python data source: ``spark.read.format("paged_json")``.

Options are what a connector's search takes: ``theme`` (words that the title
must contain), ``year_min``, ``year_max``, ``venues`` (separated by bars; rows without a venue
pass), ``limit`` (rows of the whole scan, in order of the page files), and
``attempts``, ``base_s``, ``max_s`` of the retry policy.  A partition is a page
file, or all of them where there is a limit; options and pushed-down equalities are applied while reading.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "source string, source_id string, title string, venue string, year string, doi string, arxiv_id string, url string"
_FIELDS = ("source", "source_id", "title", "venue", "year", "doi", "arxiv_id", "url")


def waits(attempts: int, base_s: float, max_s: float) -> list[float]:
    """Pauses between attempts: doubling from ``base_s``, ``max_s`` at most."""
    return [min(base_s * 2**k, max_s) for k in range(max(0, attempts - 1))]


def with_retries(call: Callable, attempts: int = 1, base_s: float = 0.2, max_s: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``, tried again after OSError (which time-outs are), not after other errors."""
    pauses = waits(attempts, base_s, max_s)
    for k in range(max(1, attempts)):
        try:
            return call()
        except OSError:
            if k >= len(pauses):
                raise
            sleep(pauses[k])
    return None


class Page(InputPartition):
    def __init__(self, *paths: str):
        self.paths = paths


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.equal: dict[str, set[str]] = {}

    def pushFilters(self, filters: list) -> Iterator:
        """Equalities of a column with one or some texts are taken over; the others are given back."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else ""
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in _FIELDS and wanted is not None and all(isinstance(x, str) for x in wanted):
                self.equal[name] = self.equal.get(name, wanted) & wanted
            else:
                yield f

    def partitions(self) -> list[Page]:
        paths = sorted(str(p) for p in Path(self.options["path"]).glob("*.json"))
        return [Page(*paths)] if "limit" in self.options else [Page(p) for p in paths]

    def read(self, page: Page) -> Iterator[tuple]:
        o = self.options
        retry = int(o.get("attempts", 1)), float(o.get("base_s", 0.2)), float(o.get("max_s", 2.0))
        low, high, left = int(o.get("year_min", 0)), int(o.get("year_max", 9999)), int(o.get("limit", 1 << 62))
        words, venues = o.get("theme", "").lower().split(), [v.strip().lower() for v in o.get("venues", "").split("|") if v.strip()]
        for path in page.paths:
            for row in json.loads(with_retries(Path(path).read_text, *retry)).get("results", []):
                cells = {k: str(row.get(k) or "").strip() for k in _FIELDS}
                year, venue = cells["year"], cells["venue"].lower()
                if year.isdigit() and not low <= int(year) <= high or not all(w in cells["title"].lower() for w in words):
                    continue
                if venues and venue and venue not in venues or any(cells[k] not in v for k, v in self.equal.items()):
                    continue
                if left <= 0:
                    return
                left -= 1
                yield tuple(cells[k] for k in _FIELDS)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters of queries reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)

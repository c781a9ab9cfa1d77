"""A paged feature service as a Spark data source: a partition per page."""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, offset: int):
        super().__init__(offset)
        self.offset = offset


class FeatureReader(DataSourceReader):
    """Reads pages of `pagesize` features, `maxpages` of them; the fields are those of the schema, never all.

    Nothing is cut silently: a last page that says there is more, or one that is shorter than asked
    for and says so, is an error."""

    def __init__(self, schema, options: dict):
        self.fields = [f.name for f in schema.fields]
        self.url, self.where, self.order = options["url"], options.get("where", "1=1"), options.get("orderby", "")
        self.size, self.pages = int(options.get("pagesize", 200)), int(options.get("maxpages", 25))

    def partitions(self) -> list[_Page]:
        return [_Page(k * self.size) for k in range(self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        asked = {"where": self.where, "outFields": ",".join(self.fields), "returnGeometry": "false", "orderByFields": self.order, "resultOffset": partition.offset, "resultRecordCount": self.size, "f": "json"}
        url = f"{self.url}?{urllib.parse.urlencode(asked)}" if self.url.startswith("http") else f"{self.url}/{partition.offset}.json"
        try:
            with urllib.request.urlopen(url, timeout=120) as r:  # noqa: S310
                page = json.load(r)
        except FileNotFoundError:
            return
        except urllib.error.URLError as e:
            if isinstance(e.reason, FileNotFoundError):
                return
            raise
        if "error" in page:
            raise ValueError(f"the service answered with an error: {page['error']}")
        more, n = page.get("exceededTransferLimit", False), len(page.get("features", []))
        if more and (n < self.size or partition.offset + self.size >= self.pages * self.size):
            raise ValueError(f"{self.url} has more than its pages give: raise maxpages above {self.pages}, or lower pagesize to {n or 1}")
        for feature in page.get("features", []):
            a = feature["attributes"]
            yield tuple(None if a.get(f) is None else str(a[f]) for f in self.fields)


class FeatureService(DataSource):
    """spark.dataSource.register(FeatureService); spark.read.format("features").schema(...).options(url=...).load()"""

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        raise ValueError("give a schema: its fields are what is asked for")

    def reader(self, schema) -> FeatureReader:
        return FeatureReader(schema, self.options)

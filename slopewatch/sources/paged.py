"""Paged JSON feeds as a Spark data source: pages are partitions, read by the executors.

``feed(spark, url, schema, **options)``, or ``spark.read.format("paged_json")``, with the options ``url`` (a template with
{offset}, {limit}, {page} from 1, {since} and {where}; http(s), or any path or URI that Arrow's file systems open: a JSON file,
or a folder of JSON lines), ``limit`` (rows of a page), ``cap`` (last offset), ``stride`` (pages that one task reads in turn until
a short one), ``since`` and ``since_column`` (rows below are left out, whether the feed has filtered or not), ``upper`` (columns
that the feed compares in capitals) and ``attempts``.  A request that fails is made again after 1, 2, 4 ... seconds.

Comparisons and LIKE patterns on columns go to the feed as {where}, and are applied to what it sends, so a feed that ignores
them does no harm; what it can't be asked is left to Spark.

As a stream, a batch is a range of offsets of at most ``batch`` pages, planned on the driver with a few requests and read by the
executors page by page; a batch that is run again reads the same range.  ``progress`` names a file for the end of the
newest planned batch: with it a query that is started again goes on in batches of that size too.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType


def _opened(uri: str):
    """An Arrow file system and the path there of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


def _stored(uri: str) -> list[dict]:
    """Rows of a JSON file, or of all JSON lines in a folder; none where nothing is."""
    from pyarrow import fs

    system, path = _opened(uri)
    found = system.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        return []
    if found.type == fs.FileType.File:
        with system.open_input_file(path) as f:
            return json.loads(f.read())
    rows = []
    for one in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if one.type == fs.FileType.File and not one.base_name.startswith(("_", ".")):
            with system.open_input_file(one.path) as f:
                rows += [json.loads(line) for line in f.read().splitlines() if line]
    return rows


def fetch(url: str, attempts: int = 3) -> list[dict]:
    """Rows of a page; a page that isn't there, or behind the last one, has none."""
    import urllib.error
    import urllib.request

    from .readers import retried

    def once() -> list[dict]:
        if not url.startswith(("http://", "https://")):
            return _stored(url)
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code in (400, 404):
                return []
            raise

    return retried(once, attempts)


class Pages(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


COMPARED: dict[type, tuple[str, Callable[[str, str], bool]]] = {
    EqualTo: ("=", lambda a, b: a == b),
    GreaterThan: (">", lambda a, b: a > b),
    GreaterThanOrEqual: (">=", lambda a, b: a >= b),
    LessThan: ("<", lambda a, b: a < b),
    LessThanOrEqual: ("<=", lambda a, b: a <= b),
}
LIKE: dict[type, tuple[str, Callable[[str, str], bool]]] = {
    StringContains: ("%{}%", lambda a, b: b in a),
    StringStartsWith: ("{}%", lambda a, b: a.startswith(b)),
    StringEndsWith: ("%{}", lambda a, b: a.endswith(b)),
}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Asked:
    """A filter that the feed is asked to apply, and that is applied to its answer."""

    def __init__(self, column: str, clause: str, kind: str, value):
        self.column, self.clause, self.kind, self.value = column, clause, kind, value

    @classmethod
    def of(cls, f: Filter, upper: set[str]) -> Asked | None:
        """None for a filter that can't be sent: on a part of a column, or of another kind."""
        if len(getattr(f, "attribute", ())) != 1:
            return None
        column, kind = f.attribute[0], type(f).__name__
        if type(f) in COMPARED and isinstance(f.value, str):
            return cls(column, f"{column} {COMPARED[type(f)][0]} {quoted(f.value)}", kind, f.value)
        if type(f) in LIKE and isinstance(f.value, str):
            pattern = LIKE[type(f)][0].format(f.value)
            return cls(column, f"upper({column}) like {quoted(pattern.upper())}" if column in upper else f"{column} like {quoted(pattern)}", kind, f.value)
        if isinstance(f, In) and all(isinstance(v, str) for v in f.value):
            return cls(column, f"{column} in ({', '.join(map(quoted, f.value))})", kind, tuple(f.value))
        return None

    def holds(self, value: str | None) -> bool:
        if value is None:
            return False
        if self.kind == "In":
            return value in self.value
        test = next(t for known in (COMPARED, LIKE) for k, (_, t) in known.items() if k.__name__ == self.kind)
        return test(value, self.value)


def as_text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


class _Settings:
    def __init__(self, options: dict, schema: StructType):
        self.url = options["url"]
        self.limit = int(options.get("limit", 5000))
        self.cap = int(options.get("cap", 20000))
        self.stride = int(options.get("stride", 1))
        self.since, self.since_column = options.get("since", ""), options.get("since_column")
        self.attempts = int(options.get("attempts", 3))
        self.upper = {c.strip() for c in options.get("upper", "").split(",")} - {""}
        self.names = schema.fieldNames()
        self.asked: list[Asked] = []

    def page(self, offset: int) -> tuple[list[tuple], int]:
        """The wanted rows of a page, and how many it has."""
        where = urllib.parse.quote(" and ".join(a.clause for a in self.asked) or "1=1")
        rows = fetch(self.url.format(offset=offset, limit=self.limit, page=offset // self.limit + 1, since=self.since, where=where), self.attempts)
        wanted = [r for r in rows if not self.since_column or str(r.get(self.since_column) or "") >= self.since]
        wanted = [r for r in wanted if all(a.holds(as_text(r.get(a.column))) for a in self.asked)]
        return [tuple(as_text(r.get(n)) for n in self.names) for r in wanted], len(rows)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.settings = _Settings(options, schema)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            asked = Asked.of(f, self.settings.upper)
            if asked is None:
                yield f
            else:
                self.settings.asked.append(asked)

    def partitions(self) -> list[Pages]:
        s = self.settings
        step = s.limit * s.stride
        return [Pages(a, min(a + step, s.cap + s.limit)) for a in range(0, s.cap + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        s = self.settings
        for offset in range(partition.first, partition.last, s.limit):
            rows, n = s.page(offset)
            yield from rows
            if n < s.limit:
                return


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.settings = _Settings(options, schema)
        self.batch = int(options.get("batch", 64))
        self.progress = options.get("progress")
        self.at: int | None = None  # the end of the newest planned batch

    def initialOffset(self) -> dict:
        self.at = 0
        return {"offset": 0}

    def _known(self) -> int | None:
        if self.at is None and self.progress:
            found = fetch(self.progress)
            self.at = found["offset"] if found else 0
        return self.at

    def _end(self, first: int, pages: int) -> int:
        """Rows up to the end of the feed, or of so many pages from page ``first`` on; pages fill up in order."""
        limit, low, high = self.settings.limit, first, first + pages - 1
        rows = self.settings.page(high * limit)[1]
        if rows == limit:
            return (high + 1) * limit
        while low < high:  # the first page that isn't full
            middle = (low + high) // 2
            n = self.settings.page(middle * limit)[1]
            low, high, rows = (middle + 1, high, rows) if n == limit else (low, middle, n)
        return low * limit + rows

    def latestOffset(self) -> dict:
        known = self._known()
        if known is not None:
            return {"offset": max(known, self._end(known // self.settings.limit, self.batch))}
        pages = self.batch  # started again without a file of its progress: where it stands isn't known, so all there is
        while self._end(0, pages) == pages * self.settings.limit:
            pages *= 2
        return {"offset": self._end(0, pages)}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        first, last, limit = start["offset"], end["offset"], self.settings.limit
        self.at = max(last, self.at or 0)
        if self.progress:
            system, path = _opened(self.progress)
            with system.open_output_stream(path) as f:
                f.write(json.dumps({"offset": self.at}).encode())
        edges = [first, *range((first // limit + 1) * limit, last, limit), last]
        return [Pages(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b]

    def read(self, partition: Pages) -> Iterator[tuple]:
        page = partition.first // self.settings.limit * self.settings.limit
        return iter(self.settings.page(page)[0][partition.first - page : partition.last - page])


class PagedJson(DataSource):
    """All columns are text; what isn't text in a row is JSON."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "fechaobservacion string, latitud string, longitud string, valorobservado string, codigoestacion string, municipio string, descripcionsensor string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options, schema)


def _reader(spark: SparkSession, source, url: str, schema: str | None, options: dict):
    spark.dataSource.register(PagedJson)
    reader = source.format("paged_json").options(url=url, **{k: str(v) for k, v in options.items()})
    return reader.schema(schema) if schema else reader


def feed(spark: SparkSession, url: str, schema: str | None = None, **options) -> DataFrame:
    """The rows of a paged feed; filters on its columns are sent along."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return _reader(spark, spark.read, url, schema, options).load()


def stream(spark: SparkSession, url: str, schema: str | None = None, **options) -> DataFrame:
    """A paged feed that grows at its end, as a stream."""
    return _reader(spark, spark.readStream, url, schema, options).load()

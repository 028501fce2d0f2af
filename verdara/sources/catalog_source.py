"""The catalogue as a Python data source, `stac_catalog`: a partition a date window, filters pushed to files or to a server.

Options: `path` names a snapshot that `write_snapshot` wrote, or `endpoint` a server with a STAC search; `start` and
`end` (dates, both needed for a server) bound the time; `days` cuts a server's time into windows, `cap` bounds the
items that a server gives of a window, and `page` those of a request.

Snapshot: items in Parquet files by window and place, and an index of each file's least and largest values. Filters on
collection, ts, cloud and the four sides of the bbox skip windows and files before any is opened; what is left of a
file is filtered by its row groups. Server: the same filters become the body of the search; each request is tried
four times, waiting longer each time. Spark applies all filters again, so pushing them is never a matter of results.

Defined cases: a NULL passes no pushed comparison, as in SQL; without a filter all files are read; a snapshot
without items gives no rows; the last rows of a window of which `cap` items came have `truncated` set.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from verdara.session import ship

SIDES = ("west", "south", "east", "north")
SCHEMA = "item_id string, collection string, ts timestamp, cloud double, west double, south double, east double, north double, item string, window_start date, truncated boolean"
KNOWN = ("collection", "ts", "cloud", *SIDES)
TRIES, PAUSE = 4, 0.5
_LOW, _HIGH = (GreaterThan, GreaterThanOrEqual), (LessThan, LessThanOrEqual)


@dataclass
class Window(InputPartition):
    """One date window: its first and last day, and the files that may hold rows of it."""

    start: date | None
    end: date | None
    files: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(None)


def _plain(value):
    """Comparable with what the index holds: times as naive UTC."""
    return value.astimezone(UTC).replace(tzinfo=None) if isinstance(value, datetime) and value.tzinfo else value


class Pushed:
    """Comparisons that Spark offered: (column, class, value)."""

    def __init__(self) -> None:
        self.terms: list[tuple[str, type, object]] = []

    def take(self, f: Filter) -> None:
        if isinstance(f, (EqualTo, In, *_LOW, *_HIGH)) and len(f.attribute) == 1 and f.attribute[0] in KNOWN and f.value is not None:
            self.terms.append((f.attribute[0], type(f), _plain(f.value)))

    def may_hold(self, row: dict) -> bool:
        """Whether a file with these least and largest values may have a row that passes."""
        for name, kind, value in self.terms:
            low, high = row[f"min_{name}"], row[f"max_{name}"]
            wanted = [v for v in value if v is not None] if kind is In else [value]
            if low is None or kind in _LOW and not (high > value or kind is GreaterThanOrEqual and high == value):
                return False
            if kind in _HIGH and not (low < value or kind is LessThanOrEqual and low == value):
                return False
            if kind in (EqualTo, In) and not any(low <= v <= high for v in wanted):
                return False
        return True

    def bounds(self, name: str) -> tuple[object | None, object | None]:
        """(least, largest) that the comparisons leave of a column."""
        low = [v for n, k, v in self.terms if n == name and k in (*_LOW, EqualTo)]
        high = [v for n, k, v in self.terms if n == name and k in (*_HIGH, EqualTo)]
        return max(low, default=None), min(high, default=None)

    def arrow(self):
        """The same comparisons for row groups; NULL if there is none."""
        import pyarrow.compute as pc

        out = None
        for name, kind, value in self.terms:
            f = pc.field(name)
            if isinstance(value, datetime):
                value = pa.scalar(value.replace(tzinfo=UTC), pa.timestamp("us", "UTC"))
            term = {EqualTo: lambda: f == value, In: lambda: f.isin([v for v in value if v is not None]), GreaterThan: lambda: f > value, GreaterThanOrEqual: lambda: f >= value, LessThan: lambda: f < value, LessThanOrEqual: lambda: f <= value}[kind]()  # noqa: B023
            out = term if out is None else out & term
        return out


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.endpoint = options.get("path"), options.get("endpoint")
        self.start, self.end = (date.fromisoformat(options[k]) if k in options else None for k in ("start", "end"))
        self.days, self.cap, self.page = int(options.get("days", 370)), int(options["cap"]) if "cap" in options else None, int(options.get("page", 100))
        if not self.path and not (self.endpoint and self.start and self.end):
            raise ValueError("stac_catalog needs a path, or an endpoint with start and end")
        self.pushed = Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.pushed.take(f)
            yield f  # Spark checks every row again

    def partitions(self) -> list[Window]:
        return self._snapshot_windows() if self.path else self._server_windows()

    def _snapshot_windows(self) -> list[Window]:
        import pyarrow.parquet as pq

        filesystem, root = _open(f"{self.path}/index")
        found: dict[date, Window] = {}
        for row in pq.read_table(root, filesystem=filesystem).to_pylist():
            start = row["window_start"]
            day = lambda v: v.date() if isinstance(v, datetime) else v
            row = {k: _plain(v) for k, v in row.items()}
            if self.start and day(row["max_ts"]) < self.start or self.end and day(row["min_ts"]) > self.end or not self.pushed.may_hold(row):
                continue
            found.setdefault(start, Window(start, None)).files.append(row["file"])
        return [found[k] for k in sorted(found)] or [Window(None, None)]

    def _server_windows(self) -> list[Window]:
        low, high = self.pushed.bounds("ts")
        start, end = max(self.start, low.date()) if low else self.start, min(self.end, high.date()) if high else self.end
        span = (end - start).days + 1
        size = -(-span // max(1, -(-span // self.days)))
        return [Window(a, min(end, a + timedelta(size - 1))) for a in (start + timedelta(k) for k in range(0, span, max(1, size)))] or [Window(None, None)]

    def read(self, window: Window) -> Iterator[pa.RecordBatch]:
        if self.path:
            yield from self._read_files(window)
        elif window.start:
            yield from self._search(window)

    def _read_files(self, window: Window) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        import pyarrow.compute as pc

        names = ["item_id", "collection", "ts", "cloud", *SIDES, "item"]
        keep = self.pushed.arrow()
        for bound, op in ((self.start, pc.greater_equal), (self.end and self.end + timedelta(1), pc.less)):
            if bound:
                term = op(pc.field("ts"), pa.scalar(datetime(bound.year, bound.month, bound.day, tzinfo=UTC), pa.timestamp("us", "UTC")))
                keep = term if keep is None else keep & term
        for file in sorted(window.files):
            filesystem, path = _open(file)
            for batch in ds.dataset(path, filesystem=filesystem, format="parquet").to_batches(columns=names, filter=keep, batch_size=4096):
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([window.start] * batch.num_rows, pa.date32()), pa.array([False] * batch.num_rows)], [*names, "window_start", "truncated"])

    # -- server ------------------------------------------------------------------------------------------

    def body(self, window: Window) -> dict:
        """A search's body by what was pushed."""
        out: dict = {"datetime": f"{window.start}T00:00:00Z/{window.end}T23:59:59.999999Z", "limit": min(self.page, self.cap or self.page), "sortby": [{"field": "properties.datetime", "direction": "asc"}]}
        names = [v for n, k, v in self.pushed.terms if n == "collection" for v in (v if k is In else [v]) if v is not None]
        if names:
            out["collections"] = sorted(set(names))
        high = self.pushed.bounds("cloud")[1]
        if high is not None:
            out["query"] = {"eo:cloud_cover": {"lt" if any(n == "cloud" and k is LessThan and v == high for n, k, v in self.pushed.terms) else "lte": high}}
        # A box meets another if its west lies before the other's east, and so on.
        box = [self.pushed.bounds("east")[0], self.pushed.bounds("north")[0], self.pushed.bounds("west")[1], self.pushed.bounds("south")[1]]
        if all(v is not None for v in box) and box[0] <= box[2] and box[1] <= box[3]:
            out["bbox"] = box
        return out

    def _request(self, url: str, body: dict | None) -> dict:
        for attempt in range(TRIES):
            try:
                data = None if body is None else json.dumps(body).encode()
                with urllib.request.urlopen(urllib.request.Request(url, data, {"Content-Type": "application/json"}), timeout=60) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError, ConnectionError, json.JSONDecodeError) as e:
                asked_wrongly = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code != 429
                if asked_wrongly or attempt == TRIES - 1:
                    raise
                time.sleep(PAUSE * 2**attempt)
        raise AssertionError

    def _search(self, window: Window) -> Iterator[pa.RecordBatch]:
        url, body, came = f"{self.endpoint.rstrip('/')}/search", self.body(window), 0
        kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), *[pa.float64()] * 5, pa.string(), pa.date32(), pa.bool_()]
        while url:
            answer = self._request(url, body)
            items = answer.get("features", [])
            items = items if self.cap is None else items[: self.cap - came]
            came += len(items)
            rows = [self._row(i) for i in items]
            full = self.cap is not None and came >= self.cap
            if rows:
                columns = [*zip(*rows, strict=True), [window.start] * len(rows), [full] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [*("item_id", "collection", "ts", "cloud"), *SIDES, "item", "window_start", "truncated"])
            after = next((x for x in answer.get("links", []) if x.get("rel") == "next"), None)
            url = None if full or after is None else after["href"]
            body = None if after is None or after.get("method", "GET") == "GET" else {**body, **(after.get("body") or {})}

    def _row(self, item: dict) -> tuple:
        properties, box = item.get("properties") or {}, item.get("bbox") or [None] * 4
        at = properties.get("datetime")
        return (item.get("id"), item.get("collection"), datetime.fromisoformat(at) if at else None, properties.get("eo:cloud_cover"), *[None if v is None else float(v) for v in box[:4]], json.dumps(item))


class StacCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stac_catalog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(dict(self.options))


def scan(spark: SparkSession, **options) -> DataFrame:
    """The catalogue as a table; `where` on collection, ts, cloud and the bbox's sides is pushed down."""
    ship(spark)
    spark.dataSource.register(StacCatalog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("stac_catalog").options(**options).load()


def in_box(west: float, south: float, east: float, north: float):
    """The condition that an item's bbox meets a box."""
    return (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)


def write_snapshot(items: DataFrame, path: str, days: int = 370, rows_per_file: int = 100_000) -> None:
    """Items (item_id, collection, ts, cloud, west, south, east, north, item) as files by date window and place, and their index.

    One shuffle by window; inside a window rows are sorted by collection and cells of 45 degrees, so that a file
    holds few collections and places. A window's rows go to as many tasks as it has cells.
    """
    start = F.date_add(F.lit(date(1970, 1, 1)), (F.floor(F.datediff(F.to_date("ts"), F.lit(date(1970, 1, 1))) / days) * days).cast("int"))
    cell = F.floor((F.col("west") + 180) / 45) * 8 + F.floor((F.col("south") + 90) / 45)
    rows = items.where("ts is not null").select("item_id", "collection", F.col("ts").cast("timestamp").alias("ts"), F.col("cloud").cast("double").alias("cloud"), *[F.col(s).cast("double").alias(s) for s in SIDES], "item", start.alias("window_start"), cell.alias("_cell"))
    rows = rows.repartitionByRange("window_start", "collection", "_cell").sortWithinPartitions("window_start", "collection", "_cell", "ts")
    spark, kind = items.sparkSession, "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(kind)
    try:
        spark.conf.set(kind, "TIMESTAMP_MICROS")  # the other kind has no least and largest values
        rows.drop("_cell").write.option("maxRecordsPerFile", rows_per_file).partitionBy("window_start").parquet(f"{path}/items")
    finally:
        spark.conf.set(kind, before)
    written = spark.read.schema(rows.drop("_cell").schema).parquet(f"{path}/items")
    spans = [f(c).alias(f"{n}_{c}") for c in KNOWN for n, f in (("min", F.min), ("max", F.max))]
    written.groupBy(F.col("_metadata.file_path").alias("file"), "window_start").agg(F.count("*").alias("items"), *spans).write.parquet(f"{path}/index")

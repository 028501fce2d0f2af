"""Metrics of jobs, observed while they run: counters, and histograms that add up.

A histogram is counts by fixed boundaries beside sum, count, least and largest value, so what tasks, batches and runs saw is
merged by adding. `observe` puts them on a DataFrame as it is written: nothing is read twice. A stream's batches reach a
`Collector`; a batch job's are in its `Observation`. `histograms` makes the same rows of a stored table of runs.

A NULL or NaN counts nowhere; a value on a boundary counts below it; without a value least and largest are NULL.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

_SECONDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 300.0, 900.0)
_SHARES = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0)
# The columns that are measured, their names in reports, and their boundaries.
HISTOGRAMS = {
    "job_duration": ("job.duration", _SECONDS), "queue_delay": ("queue.delay", _SECONDS), "scene_duration": ("scene.duration", _SECONDS),
    "valid_pixel_pct": ("scene.valid_pixel_pct", _SHARES), "upload_duration": ("blob.upload_duration", _SECONDS), "search_duration": ("stac.duration", _SECONDS),
}
COUNTERS = {"succeeded": "analyses.succeeded", "failed": "analyses.failed"}


def _measures(columns: Iterable[str]) -> list[Column]:
    """One number each, named `column:what`."""
    out = []
    for name, (_, bounds) in HISTOGRAMS.items():
        if name in columns:
            v = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
            out += [F.count(v).alias(f"{name}:count"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"{name}:sum"), F.min(v).alias(f"{name}:min"), F.max(v).alias(f"{name}:max")]
            out += [F.count_if(v <= b).alias(f"{name}:{k}") for k, b in enumerate(bounds)]
    if "status" in columns:
        out += [F.count_if(F.col("status") == s).alias(s) for s in COUNTERS]
    return out


def observe(rows: DataFrame, how: str | Observation = "job-metrics") -> DataFrame:
    """`rows`, whose measured columns are counted as they pass."""
    return rows.observe(how, *_measures(rows.columns))


def merge(seen: Iterable[dict]) -> dict:
    """What several observations saw together."""
    out: dict = {}
    for one in seen:
        for name, value in one.items():
            if value is not None:
                fold = min if name.endswith(":min") else max if name.endswith(":max") else lambda a, b: a + b
                out[name] = value if name not in out else fold(out[name], value)
    return out


def report(seen: dict) -> list[dict]:
    """A row a histogram and counter, by name: name, count, sum, least, most, and counts up to each boundary and beyond."""
    rows = [{"name": n, "count": seen.get(s, 0), "sum": None, "least": None, "most": None, "counts": None} for s, n in COUNTERS.items() if s in seen]
    for column, (name, bounds) in HISTOGRAMS.items():
        if f"{column}:count" in seen:
            upto = [seen.get(f"{column}:{k}", 0) for k in range(len(bounds))] + [seen[f"{column}:count"]]
            counts = [b - a for a, b in zip([0, *upto], upto, strict=False)]
            rows.append({"name": name, "count": upto[-1], "sum": seen.get(f"{column}:sum", 0.0), "least": seen.get(f"{column}:min"), "most": seen.get(f"{column}:max"), "counts": counts})
    return sorted(rows, key=lambda r: r["name"])


class Collector(StreamingQueryListener):
    """Gathers what the batches of all streams observed under a name."""

    def __init__(self, name: str = "job-metrics") -> None:
        self.name, self.seen, self.batches, self._lock = name, {}, 0, threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802  named by Spark
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self._lock:
                self.seen = merge([self.seen, row.asDict()])
                self.batches += 1

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def histograms(runs: DataFrame) -> DataFrame:
    """(name, count, sum, least, most, counts) of a stored table of runs: one aggregate, then a row a metric."""
    one = runs.agg(*_measures(runs.columns))
    c = lambda n: F.col(f"`{n}`")
    rows = []
    for column, (name, bounds) in HISTOGRAMS.items():
        if column in runs.columns:
            upto = [c(f"{column}:{k}") for k in range(len(bounds))] + [c(f"{column}:count")]
            counts = F.array(upto[0], *[b - a for a, b in zip(upto, upto[1:], strict=False)])
            rows.append((F.lit(name), upto[-1], c(f"{column}:sum"), c(f"{column}:min"), c(f"{column}:max"), counts))
    none = [F.lit(None).cast(t) for t in ("double", "double", "double", "array<bigint>")]
    rows += [(F.lit(n), c(s), *none) for s, n in COUNTERS.items() if "status" in runs.columns]
    fields = ("name", "count", "sum", "least", "most", "counts")
    return one.select(F.inline(F.array(*[F.struct(*[v.alias(f) for f, v in zip(fields, r, strict=True)]) for r in rows])))

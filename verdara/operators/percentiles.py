"""Exact percentiles by refinement: passes of bounded state in place of a map of all values.

An order statistic lies between the least and the largest value of its group. A pass cuts that interval into
`bins`, counts its values by bin, and keeps the least and the largest value of the bin that holds the
wanted place; when they are equal, that is the statistic. A pass has one row a bin, partial sums meet before they are
shuffled, and later passes read the few values inside open intervals only, so a group of any size is a few hundred rows to any task.
Each pass parts the least from the largest value, so they end; floats in one range take three or four.

Interpolation is linear between the two places beside share * (n - 1). NULL and NaN values count for nothing; a group
without a value has no row; infinite values are values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdara.session import scratch_path

BINS = 1024


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Place of a value between two others; never falls as the value grows. Halves, so that no difference overflows.

    Beside an infinite end, ends apart and all else in between.
    """
    part = (v / 2 - low / 2) / (high / 2 - low / 2)
    inside = F.least(F.greatest(F.floor(part * bins), F.lit(1)), F.lit(bins - 2))
    within = F.when(F.isnan(part), F.lit(1).cast("long")).otherwise(inside)
    return F.when(v == low, F.lit(0).cast("long")).when(v == high, F.lit(bins - 1).cast("long")).otherwise(within)


def exact(values: DataFrame, key: str, value: Column, shares: list[float], bins: int = BINS) -> DataFrame:
    """(key, n, shares): the percentiles of each group, in the order asked."""
    c = F.col
    v = values.select(c(key).alias("key"), value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    groups = _stored(v.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "percentile-groups")
    asked = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("nth", "share")
    asked = groups.select("key", "n", asked).withColumn("at", c("share") * (c("n") - 1))
    places = asked.select("key", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("k")).distinct()
    found = _stored(places.join(groups, places["key"].eqNullSafe(groups["key"])).select(places["key"], "k", "low", "high", F.lit(0).cast("long").alias("below")), "percentile-places")
    while not found.where("low < high").isEmpty():
        open_ = found.where("low < high").select("key", "low", "high", "below").distinct()
        rows = v.join(open_, v["key"].eqNullSafe(open_["key"]) & c("v").between(c("low"), c("high"))).select(open_["key"], "low", "high", "below", "v")
        own = ["key", "low", "high", "below"]
        counted = rows.groupBy(*own, _bin(c("v"), c("low"), c("high"), bins).alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("m").over(Window.partitionBy(*own).orderBy("bin")) - c("m")
        counted = counted.select(*[c(x).alias(f"c_{x}") for x in own], (c("below") + before).alias("start"), "m", "least", "most")
        here = found["key"].eqNullSafe(c("c_key")) & (c("low") == c("c_low")) & (c("high") == c("c_high")) & (c("below") == c("c_below")) & (c("k") >= c("start")) & (c("k") < c("start") + c("m"))
        nearer = found.where("low < high").join(counted, here).select("key", "k", c("least").alias("low"), c("most").alias("high"), c("start").alias("below"))
        found = _stored(found.where("low >= high").unionByName(nearer), "percentile-places")
    at = found.select(c("key").alias("f_key"), "k", c("low").alias("value"))
    ends = [at.select(*[c(x).alias(f"{x}{k}") for x in ("f_key", "k", "value")]) for k in (0, 1)]
    out = asked.join(ends[0], c("key").eqNullSafe(c("f_key0")) & (F.floor("at") == c("k0"))).join(ends[1], c("key").eqNullSafe(c("f_key1")) & (F.ceil("at") == c("k1")))
    part = c("at") - F.floor("at")
    share = F.when(c("value0") == c("value1"), c("value0")).otherwise((1 - part) * c("value0") + part * c("value1"))
    by = out.withColumn("value", share).groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("nth", "value"))).alias("s"))
    return by.select(c("key").alias(key), "n", F.transform("s", lambda x: x["value"]).alias("shares"))

"""Tables laid out for joins that recur: bucketed and sorted by their key, so that joining them shuffles nothing.

Each bucket is one file, written by the task that holds its keys. Tables of one key and number of buckets join bucket by
bucket; a reader that filters by key opens its bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def store(rows: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """Store rows as the table `name` at `path`, and give it back."""
    spark = rows.sparkSession
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def joined(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Tables that are bucketed alike, joined bucket by bucket; sides are merged, none is broadcast, whatever its size."""
    return left.hint("merge").join(right, left[left_key] == right[right_key], how)

"""Percentiles by refinement against numpy, and joins of bucketed tables without a shuffle."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from verdara.operators import percentiles
from verdara.plans.registry import QUERIES

SHARES = [0.5, 0.1, 0.25, 0.75, 0.9, 0.0, 1.0]


@pytest.mark.parametrize("bins", [32, 1024])
def test_percentiles_of_hard_groups(spark, bins):
    rng = random.Random(1)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "same": [7.0] * 50, "skewed": [10.0 ** rng.uniform(-4, 4) * rng.choice((-1, 1)) for _ in range(300)],
        "near": [1 + k * 2.0**-52 for k in range(40)], "zeros": [0.0, -0.0, 0.0, 5e-324], "huge": [-1.7e308, 1.7e308, 0.0, 1e308], "ends": [-math.inf, 1.0, 2.0, 3.0, math.inf, math.inf], None: [rng.gauss(0, 1) for _ in range(500)],
    }
    table = [(k, v) for k, vs in groups.items() for v in vs] + [("same", None), ("same", math.nan), ("empty", None)]
    frame = spark.createDataFrame(table, "g string, v double").repartition(4)
    got = {r["g"]: r for r in percentiles.exact(frame, "g", F.col("v"), SHARES, bins).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        for share, value in zip(SHARES, got[k]["shares"], strict=True):
            s, at = sorted(vs), share * (len(vs) - 1)
            low, high = s[math.floor(at)], s[math.ceil(at)]
            want = low if low == high else (1 - (at - math.floor(at))) * low + (at - math.floor(at)) * high
            assert value == want or math.isnan(want) and math.isnan(value) or value == pytest.approx(want, rel=1e-15)
    assert percentiles.exact(frame.where("false"), "g", F.col("v"), SHARES).count() == 0


def test_no_pass_holds_a_groups_values(spark, monkeypatch):
    """Two million values in one group: no stored table of a pass has more rows than bins allow."""
    sizes, stored = [], percentiles._stored
    monkeypatch.setattr(percentiles, "_stored", lambda df, name: (lambda t: (sizes.append(t.count()), t)[1])(stored(df, name)))
    values = spark.range(2_000_000).selectExpr("1 g", "cast(sin(id) as float) v")
    (row,) = percentiles.exact(values, "g", F.col("v"), SHARES).collect()
    want = np.quantile(np.sin(np.arange(2_000_000)).astype("f4").astype("f8"), SHARES)
    assert row["shares"] == pytest.approx(want, abs=1e-6) and max(sizes) <= 2 * len(SHARES) and len(sizes) <= 7


@pytest.mark.parametrize("name", ["ts_join_bucketed", "artifacts_bucketed"])
def test_bucketed_joins_shuffle_nothing(spark, name):
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


@pytest.mark.parametrize("name", ["mosaic_first_valid", "rgb_mosaic", "process_acquisition"])
def test_mosaics_are_hashed(spark, name):
    plan = QUERIES[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert plan.count("Exchange hashpartitioning") <= {"process_acquisition": 4}.get(name, 1)

"""Refined histograms against Spark's own percentiles."""

import random

import pytest
from pyspark.sql import functions as F
from tidewheel.operators.quantiles import quantiles

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(4)
    rows = [("ties", float(rng.randint(0, 5))) for _ in range(500)] + [("wide", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 307)) for _ in range(300)]
    rows += [("plain", rng.gauss(0, 1)) for _ in range(400)] + [(None, 1.5), (None, 2.5), (None, None), ("one", 7.0), ("none", None), ("ends", -1.7e308), ("ends", 1.7e308), ("ends", 0.0)]
    return spark.createDataFrame(rows, "g string, x double").repartition(4).cache()


@pytest.mark.parametrize("continuous", [False, True])
def test_quantiles_equal_percentiles(values, continuous):
    name = "percentile_cont" if continuous else "percentile_disc"
    want = {}
    for p in SHARES:
        for r in values.filter("x is not null").groupBy("g").agg(F.expr(f"{name}({p}) within group (order by x)").alias("v")).collect():
            want[r.g, p] = r.v
    got = {(r.g, r.p): r.value for r in quantiles(values, ["g"], "x", SHARES, continuous=continuous, buckets=64, few=5).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_one_group_and_no_rows(values):
    some = values.filter("g = 'plain'")
    assert quantiles(some, [], "x", [0.5], few=10).first().value == some.agg(F.expr("percentile_disc(0.5) within group (order by x)")).first()[0]
    assert quantiles(values.limit(0), ["g"], "x", [0.5]).count() == 0

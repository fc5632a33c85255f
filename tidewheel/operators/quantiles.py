"""Exact percentiles of groups of any size by refined histograms.

Each round counts the rows between two bounds in equally wide buckets, finds the bucket of the rank that is looked for, and takes the smallest and
largest value of its rows as the next bounds. When few rows are left they are ranked. No task holds a group's values: the counts
are aggregated partially, and a rank has at most as many rows as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import checkpointed

#: Buckets of a histogram; rows that are ranked in one task at the end.
BUCKETS, FEW = 4096, 100_000


def _same(group: list[str]) -> Column:
    on = F.lit(True)
    for g in group:
        on = on & F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}"))
    return on


def _between(rows: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """Rows within the bounds of each rank of their group; a null group is a group."""
    on = _same(group) & (F.col("r.v") >= F.col("t.low")) & (F.col("r.v") <= F.col("t.high"))
    return rows.alias("r").join(targets.alias("t"), on).select(*(F.col(f"t.{g}") for g in group), "t.p", "t.side", "t.rank", "t.low", "t.high", "r.v")


def _scale(v: Column) -> Column:
    """Grows with v from the least to the largest double, by 1 where v doubles."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (1100 + F.log2(F.abs(v))))


def _share(v: Column, low: Column, high: Column) -> Column:
    """Where v lies between the bounds, from 0 to 1: by magnitude if they are more than a factor of two apart, else by value."""
    far = _scale(high) - _scale(low)
    return F.when(far > 1, (_scale(v) - _scale(low)) / far).otherwise((v - low) / (high - low))


def quantiles(df: DataFrame, group: list[str], value: str, fractions: list[float], *, continuous: bool = False, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """``group..., p, value``: the ``fractions`` of each group's values, as ``percentile_disc`` gives them, or with ``continuous`` as ``percentile`` does.

    Nulls and NaN do not count; a group without values has no row. Rounds go on until every rank has one value, or at most ``few`` rows, between its
    bounds; the bounds are values of the group, so a round always parts them. With ``BUCKETS`` buckets some seven rounds are the most.
    """
    rows = checkpointed(df.select(*group, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")))
    ends = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    each = ends.withColumn("p", F.explode(F.array(*(F.lit(float(p)) for p in fractions))))
    place = (F.col("n") - 1) * F.col("p") if continuous else F.greatest(F.ceil(F.col("n") * F.col("p")) - 1, F.lit(0)).cast("double")
    sides = F.explode(F.array(F.lit(0), F.lit(1)) if continuous else F.array(F.lit(0)))
    each = each.withColumn("place", place).withColumn("side", sides)
    rank = F.least(F.floor("place") + F.col("side"), F.col("n") - 1)
    targets = checkpointed(each.select(*group, "p", "side", "place", rank.alias("rank"), "low", "high", "n"))
    places = targets.filter("side = 0").select(*group, "p", (F.col("place") - F.floor("place")).alias("share"))
    targets, keys, done = targets.drop("place"), [*group, "p", "side"], []
    while True:
        done.append(targets.filter((F.col("low") == F.col("high")) | (F.col("n") <= few)))
        wide = targets.filter((F.col("low") < F.col("high")) & (F.col("n") > few))
        if wide.isEmpty():
            break
        share = _share(F.col("v"), F.col("low"), F.col("high"))
        counted = _between(rows, wide, group).withColumn("bucket", F.least(F.floor(share * buckets), F.lit(buckets - 1)))
        counted = counted.groupBy(*keys, "rank", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
        counted = counted.withColumn("before", upto - F.col("n"))
        hit = counted.filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        targets = checkpointed(hit.select(*keys, (F.col("rank") - F.col("before")).alias("rank"), "low", "high", "n"))
    found = done[0]
    for some in done[1:]:
        found = found.unionByName(some)
    found = checkpointed(found)
    last = _between(rows, found.filter("low < high"), group)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("v"))
    ranked = last.withColumn("_n", turn).filter(F.col("_n") == F.col("rank") + 1).select(*keys, "v")
    values = found.filter("low = high").select(*keys, F.col("low").alias("v")).unionByName(ranked)
    both = values.groupBy(*group, "p").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    if not continuous:
        return both.select(*group, "p", F.col("a").alias("value"))
    on = _same(group) & (F.col("r.p") == F.col("t.p"))
    out = both.alias("r").join(places.alias("t"), on)
    blend = F.when(F.col("r.a") == F.col("r.b"), F.col("r.a")).otherwise(F.col("r.a") * (1 - F.col("t.share")) + F.col("r.b") * F.col("t.share"))
    return out.select(*(F.col(f"r.{g}") for g in group), "r.p", blend.alias("value"))

"""Evolutionary clustering over tables of pairs: the smoothed kernels of a period are a stored table that the next period reads.

Every step runs over all groups and all numbers of clusters at once, and no step holds a group's matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import checkpointed
from . import matching, pairs
from .spectrum import BLOCK, spectral_clusters

K = "clusters"


def named_by_size(labels: DataFrame, group: list[str]) -> DataFrame:
    """``group..., member, label`` with the labels given out again from the largest cluster on, equal ones by their old label."""
    sizes = labels.groupBy(*group, F.col("label").alias("old")).agg(F.count("*").alias("n"))
    # The names that are there are used again: the n-th smallest goes to the n-th largest.
    names = sizes.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "old")))
    places = sizes.select(*group, F.col("old").alias("name"), F.row_number().over(Window.partitionBy(*group).orderBy("old")).alias("at"))
    new = names.join(places, [*group, "at"]).select(*group, F.col("old").alias("label"), F.col("name"))
    return labels.join(new, [*group, "label"]).select(*group, "member", F.col("name").alias("label"))


def map_silhouettes(found: DataFrame, kernel: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., s_sil_km``: silhouettes of clusters in the space of their eigenvectors; ``kernel`` says which pairs there are."""
    ends = [found.select(*keys, F.col("member").alias(e), F.col("x").alias(f"x{e}")) for e in "ij"]
    square = F.aggregate(F.zip_with("xi", "xj", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, c: s + c)
    apart = kernel.select(*keys, "i", "j").join(ends[0], [*keys, "i"]).join(ends[1], [*keys, "j"]).select(*keys, "i", "j", F.sqrt(square).alias("d"))
    each = pairs.member_silhouettes(apart, found.select(*keys, "member", "label"), keys)
    return each.groupBy(*keys).agg(F.avg("silhouette").alias("s_sil_km"))


def smoothed(now: DataFrame, before: DataFrame, members: DataFrame, group: list[str], search: Sequence[int], rounds: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each k: labels with their maps, the blended kernel, and the factor of each round.

    Cluster the present, then in turn estimate the factor under the labels, blend past and present by it, and cluster the blend.
    """
    keys = [*group, K]
    every = F.explode(F.array(*map(F.lit, search))).alias(K)
    now_k = checkpointed(now.select(*group, "i", "j", "w", every))
    before_k = checkpointed(before.select(*group, "i", "j", "w", every))
    members_k = members.select(*group, "member", every)
    labels = spectral_clusters(now_k, members_k, keys, max(search), by=K, block=block)
    blend, alphas = now_k, []
    for n in range(rounds):
        alpha = checkpointed(pairs.forgetting_factors(now_k, before_k, labels.select(*keys, "member", "label"), keys))
        alphas.append(alpha.withColumn("round", F.lit(n)))
        blend = checkpointed(pairs.blend(now_k, before_k, alpha, keys))
        labels = spectral_clusters(blend, members_k, keys, max(search), by=K, block=block)
    return labels, blend, reduce(DataFrame.unionByName, alphas)


def evolve(kernels: DataFrame, members: DataFrame, group: list[str], *, first: int, search: Sequence[int] = (2, 3, 4, 5), rounds: int = 3, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``group..., t, member, label, clusters`` and ``group..., t, clusters, round, alpha`` for ``kernels(group..., t, i, j, w)`` of pairs i < j.

    All periods have the pairs of the same ``members(group..., member)``. The first period has ``first`` clusters, named by size. Later ones are clustered
    over kernels smoothed with each number in ``search``; the one with the best silhouette stays (the smallest of equal ones), under
    the names that agree best with the period before. The factors are those of the number that stayed.
    """
    times = [r["t"] for r in kernels.select("t").distinct().orderBy("t").collect()]  # a few periods
    before = checkpointed(kernels.filter(F.col("t") == times[0]).select(*group, "i", "j", "w"))
    started = spectral_clusters(before, members, group, first, block=block)
    last = checkpointed(named_by_size(started.select(*group, "member", "label"), group))
    out = [last.select(*group, F.lit(times[0]).alias("t"), "member", "label", F.lit(first).alias(K))]
    factors: list[DataFrame] = []
    for t in times[1:]:
        now = kernels.filter(F.col("t") == t).select(*group, "i", "j", "w")
        labels, blend, alphas = smoothed(now, before, members, group, search, rounds, block)
        scores = map_silhouettes(labels, blend, [*group, K])
        best = checkpointed(scores.groupBy(*group).agg(F.max_by(K, F.struct("s_sil_km", -F.col(K))).alias(K)))
        mine = checkpointed(labels.join(best, [*group, K]).select(*group, "member", "label", K))
        names = matching.best_names(matching.contingency(mine.drop(K), last, group), group, max(search))
        last = checkpointed(mine.join(names.drop("f1"), [*group, "label"]).select(*group, "member", F.col("name").cast("int").alias("label"), K))
        out.append(last.select(*group, F.lit(t).alias("t"), "member", "label", K))
        factors.append(alphas.join(best, [*group, K]).withColumn("t", F.lit(t)))
        before = checkpointed(blend.join(best, [*group, K]).select(*group, "i", "j", "w"))
        last = last.drop(K)
    some = reduce(DataFrame.unionByName, factors) if factors else None
    return reduce(DataFrame.unionByName, out), some

"""Clustering measures from tables of pairs i < j, without a square matrix: silhouettes, distortion, densities, and the forgetting factor.

A table of pairs has a row for every two members of a group; ``labels`` has a row ``group..., member, label`` for each member. Every measure is
an aggregate whose partial results merge, so a group may be of any size and may lie in any number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import checkpointed
from .components import components


def labelled(pairs: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """``pairs`` with the labels ``a`` of i and ``b`` of j; pairs with a member that has no label are left out."""
    one = labels.select(*group, F.col("member").alias("i"), F.col("label").alias("a"))
    two = labels.select(*group, F.col("member").alias("j"), F.col("label").alias("b"))
    return pairs.join(one, [*group, "i"]).join(two, [*group, "j"])


def member_silhouettes(pairs: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """``group..., member, label, silhouette``: how much nearer a member is to its own cluster than to the nearest other one.

    Members alone in their cluster count 0, as do all members of a group with one cluster.
    """
    rows = labelled(pairs, labels, group)
    sides = F.explode(F.array(F.struct(F.col("i").alias("member"), F.col("b").alias("other")), F.struct(F.col("j").alias("member"), F.col("a").alias("other"))))
    sums = rows.select(*group, "d", sides.alias("s")).groupBy(*group, "s.member", "s.other").agg(F.sum("d").alias("d"))
    return silhouettes_of_sums(sums, labels, group)


def silhouettes_of_sums(sums: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """``member_silhouettes`` from ``group..., member, other, d``, the sums of a member's distances from each label's members."""
    sizes = labels.groupBy(*group, F.col("label").alias("other")).agg(F.count("*").alias("n"))
    known = sums.join(sizes, [*group, "other"]).join(labels.select(*group, "member", "label"), [*group, "member"])
    own = F.col("label") == F.col("other")
    ends = known.groupBy(*group, "member").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("d") / (F.col("n") - 1))).alias("inner"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("outer")
    )
    most = F.greatest("inner", "outer")
    value = F.when(F.col("inner").isNotNull() & F.col("outer").isNotNull() & (most > 0), (F.col("outer") - F.col("inner")) / most)
    return labels.join(ends, [*group, "member"], "left").select(*group, "member", "label", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouettes(pairs: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """``group..., s_sil_km, s_distortion``: the mean silhouette, and the sum of squared distances from the clusters' centres.

    For Euclidean distances the latter is, for each cluster, the sum of its squared pair distances over its size.
    """
    mean = member_silhouettes(pairs, labels, group).groupBy(*group).agg(F.avg("silhouette").alias("s_sil_km"))
    inner = labelled(pairs, labels, group).filter("a = b").groupBy(*group, F.col("a").alias("label")).agg(F.sum(F.col("d") * F.col("d")).alias("square"))
    sizes = labels.groupBy(*group, "label").agg(F.count("*").alias("n"))
    spread = inner.join(sizes, [*group, "label"]).groupBy(*group).agg(F.sum(F.col("square") / F.col("n")).alias("s_distortion"))
    return mean.join(spread, group, "left").select(*group, "s_sil_km", F.coalesce("s_distortion", F.lit(0.0)).alias("s_distortion"))


def density_clusters(pairs: DataFrame, members: DataFrame, group: list[str], eps: float, least: int = 5) -> DataFrame:
    """``group..., member, label`` of density clusters, 0 for noise.

    A core member has ``least`` members within ``eps``, itself included. Core members within ``eps`` of each other are one cluster; clusters are
    numbered from 1 by their smallest core member. Any other member within ``eps`` of a core one belongs to the cluster
    of the smallest number among those. With a column ``weight`` a member stands for as many that are at one place, of which it is the smallest.
    """
    weight = "weight" in members.columns
    near = checkpointed(pairs.filter(F.col("d") <= eps).select(*group, "i", "j"))
    both = near.unionByName(near.select(*group, F.col("j").alias("i"), F.col("i").alias("j")))
    all_members = members.select(*group, "member", F.col("weight") if weight else F.lit(1).alias("weight")).distinct()
    others = both.join(all_members.select(*group, F.col("member").alias("j"), "weight"), [*group, "j"]) if weight else both.withColumn("weight", F.lit(1))
    counts = others.groupBy(*group, F.col("i").alias("member")).agg(F.sum("weight").alias("n"))
    core = all_members.join(counts, [*group, "member"], "left").filter(F.coalesce("n", F.lit(0)) + F.col("weight") >= least).select(*group, "member")
    ends = [core.withColumnRenamed("member", x) for x in "ij"]
    inner = near.join(ends[0], [*group, "i"], "left_semi").join(ends[1], [*group, "j"], "left_semi")
    found = components(inner, group).withColumnRenamed("node", "member")
    rooted = core.join(found, [*group, "member"], "left").withColumn("component", F.coalesce("component", "member"))
    names = rooted.select(*group, "component").distinct().withColumn("label", F.row_number().over(Window.partitionBy(*group).orderBy("component")))
    cores = rooted.join(names, [*group, "component"]).select(*group, "member", "label")
    reached = both.join(cores.withColumnRenamed("member", "j"), [*group, "j"]).groupBy(*group, F.col("i").alias("member")).agg(F.min("label").alias("border"))
    out = all_members.join(cores, [*group, "member"], "left").join(reached, [*group, "member"], "left")
    return out.select(*group, "member", F.coalesce("label", "border", F.lit(0)).cast("int").alias("label"))


def block_moments(now: DataFrame, before: DataFrame, labels: DataFrame, group: list[str], diagonal: Column | None = None) -> DataFrame:
    """``group..., a, b, diagonal, entries, mean, variance, off``: the blocks of the matrix ``now``, and how far ``before`` is from their means.

    A block is a cluster's diagonal, its other entries, or two clusters' crossing (``a < b``); ``entries`` counts both halves of the matrix, the
    variance is the unbiased one over one half, 0 where there is one entry, and ``off`` is the sum of ``before``'s squared distances from the mean over
    both halves. ``now`` and ``before`` are kernels ``w`` of pairs i < j; the diagonal is ``diagonal`` (1 by default) in both.
    """
    both = now.select(*group, "i", "j", "w").join(before.select(*group, "i", "j", F.col("w").alias("past")), [*group, "i", "j"])
    rows = labelled(both, labels, group).select(*group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "past")
    n, mean = F.count("*"), F.avg("w")
    off = n * (F.var_pop("past") + (F.avg("past") - mean) * (F.avg("past") - mean))
    found = rows.groupBy(*group, "a", "b").agg(
        (2 * n).alias("entries"), mean.alias("mean"), F.when(n > 1, F.var_samp("w")).otherwise(0.0).alias("variance"), (2 * off).alias("off")
    )
    return with_diagonals(found, labels, group, diagonal)


def with_diagonals(found: DataFrame, labels: DataFrame, group: list[str], diagonal: Column | None = None) -> DataFrame:
    """``found`` blocks off the diagonal, and each cluster's diagonal."""
    whole = F.lit(1.0) if diagonal is None else diagonal
    ends = labels.groupBy(*group, F.col("label").alias("a")).agg(F.count("*").alias("entries"))
    ends = ends.select(*group, "a", F.col("a").alias("b"), "entries", whole.alias("mean"), F.lit(0.0).alias("variance"), F.lit(0.0).alias("off"))
    return found.withColumn("diagonal", F.lit(False)).unionByName(ends.withColumn("diagonal", F.lit(True)))


def forgetting_factors(now: DataFrame, before: DataFrame, labels: DataFrame, group: list[str]) -> DataFrame:
    """``group..., alpha``: the sum of the entries' variances over itself plus the squared distance of the past from the block means; 0 if both are 0."""
    return factors_of(block_moments(now, before, labels, group), group)


def factors_of(moments: DataFrame, group: list[str]) -> DataFrame:
    """``forgetting_factors`` from the rows of ``block_moments``."""
    noise, off = F.sum(F.col("entries") * F.col("variance")), F.sum("off")
    found = moments.groupBy(*group).agg(noise.alias("noise"), off.alias("off"))
    return found.select(*group, F.when(F.col("noise") + F.col("off") > 0, F.col("noise") / (F.col("noise") + F.col("off"))).otherwise(0.0).alias("alpha"))


def blend(now: DataFrame, before: DataFrame, alphas: DataFrame, group: list[str]) -> DataFrame:
    """``group..., i, j, w`` of past and present weighed by each group's ``alpha``."""
    both = now.select(*group, "i", "j", "w").join(before.select(*group, "i", "j", F.col("w").alias("past")), [*group, "i", "j"])
    return both.join(alphas, group).select(*group, "i", "j", (F.col("alpha") * F.col("past") + (1 - F.col("alpha")) * F.col("w")).alias("w"))

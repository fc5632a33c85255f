"""The whole clustering study over cohorts: feature searches, group searches, and profiles over group labels.

Every step is a table keyed by cohort ``g`` and by explicit columns (feature, window, gamma, clusters); distances are computed once for
each feature and window, stored, and searches fan out from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster, distance, evolve, features, modes, narrow, tracking
from ..operators.quantiles import quantiles
from ..sources import checkpointed
from .config import CLUSTERS, GAMMAS, PRODUCT_CLUSTERS, PRODUCT_GAMMAS, PRODUCT_WINDOWS, WINDOWS


def dense_features(series: DataFrame, names: list[str], bucket: str, size: int, keys: tuple[str, ...] = ("g", "student")) -> DataFrame:
    """``g, student, feature, v`` from wide series: one dense row per student and feature, zeros where a series is absent."""
    none = F.array().cast("array<double>")
    rows = F.array(
        *(
            F.struct(
                F.lit(n).alias("feature"),
                features.dense(F.coalesce(F.col(n), none), F.coalesce(F.col(f"{n}_{bucket}"), F.array().cast("array<int>")), size).alias("v"),
            )
            for n in names
        )
    )
    return series.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.feature", "x.v")


def feature_distances(rows: DataFrame, windows: list[int] | None = None, *, scaled: bool = True) -> DataFrame:
    """``g, feature, window_size, i, j, d`` by dynamic time warping, scaled to 0..1 in each group or not; series named ``*_norm`` have length 1."""
    every = F.explode(F.array(*map(F.lit, WINDOWS["dtw"] if windows is None else windows)))
    each = checkpointed(rows).withColumn("window_size", every).withColumn("unit", F.col("feature").endswith("_norm"))
    raw = checkpointed(distance.dtw_pairs(each, ["g", "feature", "window_size", "unit"], "student", "v", "window_size", normalise="unit").drop("unit"))
    if not scaled:
        return raw.select("g", "feature", "window_size", "i", "j", "d")
    known = distance.normalise(raw, ["g", "feature", "window_size"])
    return checkpointed(known.filter("d is not null").select("g", "feature", "window_size", "i", "j", "d"))


def number_rows(wide: DataFrame, names: list[str]) -> DataFrame:
    """``g, student, feature, v`` of features that are one number per student, as the distances take them."""
    rows = wide.select("g", "student", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("v")) for n in names))).alias("x"))
    return distance.numbers(rows.select("g", "student", "x.feature", "x.v"), ["g", "feature"], "student", F.col("v")).select("g", F.col("member").alias("student"), "feature", "v")


def number_distances(rows: DataFrame) -> DataFrame:
    """``feature_distances`` of ``number_rows``, Euclidean, under the one window there is."""
    raw = distance.euclidean_pairs(rows, ["g", "feature"], "student", F.col("v"))
    scaled = distance.normalise(raw.withColumn("window_size", F.lit(WINDOWS["euclidean"][0])), ["g", "feature", "window_size"])
    return scaled.filter("d is not null").select("g", "feature", "window_size", "i", "j", "d")


def search_features(distances: DataFrame, gammas: list[float] | None = None, clusters: list[int] | None = None) -> DataFrame:
    """Scores and labels of every (feature, window, gamma, k) cell of every cohort."""
    square = distance.square(distances, ["g", "feature", "window_size"], 0.0, "d")
    return checkpointed(cluster.grid_search(square, ["g", "feature", "window_size", "keys"], gammas or GAMMAS, clusters or CLUSTERS))


def score_features(distances: DataFrame, members: DataFrame) -> DataFrame:
    """Scores of ``search_features``, without labels, where ``distances`` are those of a feature's different values and ``members(g, feature, student, name)``
    says whose value each student has: students that are alike in a feature are one row of its matrices, and windows of the same distances are searched once."""
    square = distance.square(distances, ["g", "feature", "window_size"], 0.0, "d")
    once = square.groupBy("g", "feature", "keys", "matrix").agg(F.collect_list("window_size").alias("windows"))
    classes = checkpointed(distance.class_squares(members, once, ["g", "feature"], "student").drop("keys"))
    found = cluster.grid_search(classes, ["g", "feature", "windows"], GAMMAS, CLUSTERS, labels=False).drop("s_eigen")
    return checkpointed(found.withColumn("window_size", F.explode("windows")).drop("windows"))


def score_numbers(rows: DataFrame) -> DataFrame:
    """``score_features`` of ``number_rows``, which needs no distances: a student's two numbers, row and place, are all that a feature's row holds."""
    one = rows.groupBy("g", "feature").agg(F.array_sort(F.collect_list(F.struct("student", "v"))).alias("s")).filter("array_size(array_distinct(s.v)) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x, own = np.unique(batch.column("s")[r].values.field("v").to_numpy(), return_inverse=True)
                made = [pa.array([own], pa.list_(pa.int32())), pa.array([narrow.scaled(x)])]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array([r])) for c in ("g", "feature")] + made, ["g", "feature", "own", "x"])

    classes = checkpointed(one.mapInArrow(run, f"g {one.schema['g'].dataType.simpleString()}, feature string, own array<int>, x array<double>"))
    found = narrow.search(classes, ["g", "feature"], CLUSTERS, GAMMAS, labels=False)
    return checkpointed(found.withColumn("window_size", F.lit(WINDOWS["euclidean"][0])))


def best_cells(log: DataFrame) -> DataFrame:
    """The cell with the best silhouette for each cohort and feature."""
    dated = log.drop("labels", "keys", "s_eigen").withColumn("experiment_date", F.lit(0))
    return tracking.optimal_params(dated, keys=("g", "feature")).drop("experiment_date")


def group_kernels(distances: DataFrame, best: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """``g, feature_group, i, j, w``: the sum of each group's kernels at its features' best cells."""
    member = [(group, f) for group, names in groups.items() for f in names]
    side = distances.sparkSession.createDataFrame(member, "feature_group string, feature string")
    chosen = distances.join(best.select("g", "feature", "window_size", "gamma"), ["g", "feature", "window_size"])
    weighed = chosen.withColumn("w", F.exp(-F.col("gamma") * F.pow("d", F.lit(2.0)))).join(F.broadcast(side), "feature")
    return distance.kernel_sum(weighed, ["g", "feature_group"])


def group_kinds(distances: DataFrame, members: DataFrame, best: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """``g, feature_group, keys, own, matrix, narrow, whole``: ``group_kernels`` as a matrix of students that are alike in all features of the group.

    ``distances`` and ``members`` are those of ``score_features``; ``own`` says the row of each student of ``keys``. Two students that are alike have 1 for
    each feature that is not the same for all; ``whole`` is the number of features.
    """
    chosen = distances.join(best.select("g", "feature", "window_size", "gamma"), ["g", "feature", "window_size"])
    square = distance.square(chosen, ["g", "feature", "gamma"], 0.0, "d")
    classes = distance.class_squares(members, square, ["g", "feature"], "student")
    member = [(group, f, float(len(names))) for group, names in groups.items() for f in names]
    side = F.broadcast(distances.sparkSession.createDataFrame(member, "feature_group string, feature string, whole double"))
    parts = F.array_sort(F.collect_list(F.struct("feature", "gamma", "own", "matrix")))
    rows = classes.join(side, "feature").groupBy("g", "feature_group", "whole").agg(F.first("keys").alias("keys"), parts.alias("parts"))
    kept = ["g", "feature_group", "keys", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                some = batch.column("parts")[r].values
                each = np.array([x.values.to_numpy() for x in some.field("own")])
                codes, own = np.unique(each, axis=1, return_inverse=True)
                squares = [cluster.matrix_of(m) ** 2 for m in some.field("matrix")]
                kernel = sum(np.exp(-x * d[np.ix_(c, c)]) for x, d, c in zip(some.field("gamma").to_pylist(), squares, codes, strict=True))
                made = [pa.array([own.reshape(-1)], pa.list_(pa.int32())), cluster.matrix_column([kernel])]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array([r])) for c in kept] + made, [*kept, "own", "matrix"])

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(run, f"{fields}, own array<int>, matrix array<array<double>>").withColumn("narrow", F.lit(False))


def number_kinds(rows: DataFrame, best: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """``group_kinds`` of groups of ``number_rows``; ``matrix`` is the factor of the kernel sum (``narrow``), some dozen numbers for each kind of students."""
    chosen = rows.join(F.broadcast(best.select("g", "feature", "gamma")), ["g", "feature"])
    one = chosen.groupBy("g", "feature", "gamma").agg(F.array_sort(F.collect_list(F.struct("student", "v"))).alias("s"))
    member = [(group, f, float(len(names))) for group, names in groups.items() for f in names]
    side = F.broadcast(rows.sparkSession.createDataFrame(member, "feature_group string, feature string, whole double"))
    parts = F.array_sort(F.collect_list(F.struct("feature", "gamma", F.col("s.v").alias("v"))))
    wide = one.join(side, "feature").groupBy("g", "feature_group", "whole").agg(F.first("s.student").alias("keys"), parts.alias("parts"))
    kept = ["g", "feature_group", "keys", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                some = batch.column("parts")[r].values
                kinds, own = np.unique(np.array([narrow.scaled(v.values.to_numpy()) for v in some.field("v")]), axis=1, return_inverse=True)
                f = np.hstack([narrow.factor(x, gamma) for x, gamma in zip(kinds, some.field("gamma").to_pylist(), strict=True)])
                made = [pa.array([own.reshape(-1)], pa.list_(pa.int32())), cluster.matrix_column([f])]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array([r])) for c in kept] + made, [*kept, "own", "matrix"])

    fields = ", ".join(f"{c} {wide.schema[c].dataType.simpleString()}" for c in kept)
    return wide.mapInArrow(run, f"{fields}, own array<int>, matrix array<array<double>>").withColumn("narrow", F.lit(True))


def search_kinds(kinds: DataFrame, clusters: list[int] | None = None) -> DataFrame:
    """``search_groups`` of ``group_kinds`` and ``number_kinds``, without eigenvalues."""
    group, some = ["g", "feature_group", "keys"], clusters or CLUSTERS
    dense = cluster.grid_search(kinds.filter("not narrow").drop("whole", "narrow"), group, [], some, kernel=True).drop("s_eigen")
    return checkpointed(dense.unionByName(narrow.search(kinds.filter("narrow").withColumnRenamed("matrix", "x"), group, some)))


def evolve_kinds(kinds: DataFrame, log: DataFrame, clusters: list[int] | None = None) -> DataFrame:
    """``evolve_groups`` of ``group_kinds`` and their ``search_kinds``."""
    rows = kinds.join(best_clusters(log), ["g", "feature_group"])
    rows = rows.select(F.expr("g div 10").alias("g"), (F.col("g") % 10).alias("t"), "feature_group", "keys", "own", "matrix", "narrow", "clusters", "whole")
    return checkpointed(evolve.evolve_classes(rows, search=tuple(clusters or CLUSTERS)))


def group_squares(kernels: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """``g, feature_group, keys, matrix, whole`` of kernel sums; the diagonal of a sum of n kernels is n."""
    size = F.create_map(*[F.lit(x) for g, names in groups.items() for x in (g, float(len(names)))])
    square = distance.square(kernels, ["g", "feature_group"], 0.0, "w").withColumn("whole", size[F.col("feature_group")])
    filled = F.transform("matrix", lambda row, i: F.transform(row, lambda x, j: F.when(i == j, F.col("whole")).otherwise(x)))
    return square.withColumn("matrix", filled)


def search_groups(kernels: DataFrame, groups: dict[str, list[str]], clusters: list[int] | None = None) -> DataFrame:
    """Scores and labels of every k of every cohort and group."""
    squares = group_squares(kernels, groups).drop("whole")
    return checkpointed(cluster.grid_search(squares, ["g", "feature_group", "keys"], [], clusters or CLUSTERS, kernel=True))


def best_clusters(log: DataFrame) -> DataFrame:
    """``g, feature_group, clusters`` of the best silhouettes, the fewest of equally good ones."""
    return log.groupBy("g", "feature_group").agg(F.max_by("clusters", F.struct("s_sil_km", -F.col("clusters"))).alias("clusters"))


def evolve_groups(kernels: DataFrame, log: DataFrame, groups: dict[str, list[str]], clusters: list[int] | None = None) -> DataFrame:
    """``g, feature_group, student, t, label, clusters, alphas``: each group's clusters smoothed over the periods.

    A cohort ``g`` of ``kernels`` and ``log`` is ten times the cohort of the result plus the period ``t``. The first period has as many clusters as
    its own search in ``log`` chose, later ones as many as serve their smoothed kernels best.
    """
    rows = group_squares(kernels, groups).join(best_clusters(log), ["g", "feature_group"])
    rows = rows.select(F.expr("g div 10").alias("g"), (F.col("g") % 10).alias("t"), "feature_group", "keys", "matrix", "clusters", "whole")
    return checkpointed(evolve.evolve_kernels(rows, search=tuple(clusters or CLUSTERS)))


def search_products(distances: DataFrame, features: list[str]) -> DataFrame:
    """Scores of all combinations of the product grid's widths and windows for a group of two or three features."""
    some = distances.filter(F.col("feature").isin(features) & F.col("window_size").isin(PRODUCT_WINDOWS))
    squares = distance.square(some, ["g", "feature", "window_size"], 0.0, "d")
    return cluster.product_search(squares, features, PRODUCT_GAMMAS, PRODUCT_WINDOWS, PRODUCT_CLUSTERS)


def plot_series(wide: DataFrame, names: list[str], bucket: str, size: int, keys: tuple[str, ...] = ("student",)) -> DataFrame:
    """``keys..., feature, slot, v, upper``: dense series ready to be drawn, each with its feature's upper limit, the 90th percentile of all
    values that the sparse series hold (1 if that is 0). Series that sum to 0.01 or less are left out. The series are stored once, as the limit and the rows
    both read them."""
    wide = checkpointed(wide.select(*keys, *(c for n in names for c in (n, f"{n}_{bucket}"))))
    values = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names))
    each = wide.select(F.explode(values).alias("s")).select("s.feature", F.explode("s.x").alias("x")).filter(~F.isnan("x"))
    upper = quantiles(each, ["feature"], "x", [0.9], continuous=True).select("feature", F.col("value").alias("upper"))
    upper = upper.withColumn("upper", F.when(F.col("upper") == 0, 1.0).otherwise(F.col("upper")))
    rows = dense_features(wide, names, bucket, size, keys)
    shown = rows.filter(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) > 0.01)
    return shown.join(F.broadcast(upper), "feature").select(*keys, "feature", F.posexplode("v").alias("slot", "v"), "upper")


def best_labels(log: DataFrame, by: str) -> DataFrame:
    """``g, <by>, student, label`` of the cell with the best silhouette, the fewest clusters among equal ones."""
    best = log.groupBy("g", by).agg(F.max_by(F.struct("keys", "labels"), F.struct("s_sil_km", -F.col("clusters"))).alias("b"))
    rows = best.select("g", by, F.explode(F.arrays_zip("b.keys", "b.labels")).alias("x"))
    return rows.select("g", by, F.col("x.keys").alias("student"), F.col("x.labels").alias("label"))


def profiles(labels: DataFrame, groups: list[str], clusters: list[int], *, starts: int = 150) -> DataFrame:
    """k-modes profiles over each student's label in every group; a missing label is a code of its own."""
    wide = labels.groupBy("g", "student").pivot("feature_group", groups).agg(F.first("label"))
    codes = wide.select("g", "student", F.array(*(F.col(x) for x in groups)).alias("codes"))
    codes = checkpointed(codes)
    return modes.profiles(codes, modes.search(codes, ["g"], clusters, starts=starts), ["g"], "student")


def product_kernels(distances: DataFrame, combinations: list[dict[str, tuple[float, int]]]) -> DataFrame:
    """``g, combination, i, j, w``: kernel sums where each feature has its own (gamma, window), one for each combination."""
    rows = [(n, f, float(gamma), int(window)) for n, c in enumerate(combinations) for f, (gamma, window) in c.items()]
    side = distances.sparkSession.createDataFrame(rows, "combination int, feature string, gamma double, window_size int")
    weighed = distances.join(F.broadcast(side), ["feature", "window_size"]).withColumn("w", F.exp(-F.col("gamma") * F.pow("d", F.lit(2.0))))
    return distance.kernel_sum(weighed, ["g", "combination"])

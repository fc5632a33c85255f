"""The clustering study over the cohorts of two cantons, as queries.

Each canton has its own cohort, bucket and feature groups: the first, which hands in grades, the students with three school years
among those of the report, by two weeks; the second those active in all three years, by week. A cohort ``g`` of the study's
tables is ten times the canton plus the semester. A student without a row in a semester counts as zeros there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, cohort, distance, features, regularity
from ..sources import checkpointed
from . import logs, people, study
from .catalogue import _half_events, _order_years, _plain, _report, query
from .config import CAPACITY, FEATURE_GROUPS, FEATURE_GROUPS_WEEKLY, PROFILE_CLUSTERS

#: By canton: the time unit of its series, and its feature groups.
CANTONS = {1: ("biweek", FEATURE_GROUPS), 2: ("woy", FEATURE_GROUPS_WEEKLY)}


def groups_of(canton: int, metric: str) -> dict[str, list[str]]:
    return {name: group["features"] for name, group in CANTONS[canton][1].items() if group["metric"] == metric}


def features_of(canton: int, metric: str) -> list[str]:
    return [f for group in CANTONS[canton][1].values() if group["metric"] == metric for f in group["features"]]


def members(spark: SparkSession, sf_dir: str, canton: int) -> DataFrame:
    """``student`` of a canton's cohort."""
    if canton == 1:
        return cohort.with_all_years(_report(spark, sf_dir), _order_years(spark, sf_dir)).select("student").distinct()
    active = people._active(spark, sf_dir, "users")
    return cohort.with_all_years(active, active).select("student").distinct()


def semester_rows(spark: SparkSession, sf_dir: str, canton: int) -> DataFrame:
    """``g, student`` with the canton's series and measures in each of six semesters, null where a student has none."""
    unit, keys = CANTONS[canton][0], ["student", "calendar_year", "school_year", "semester"]
    names = tuple(dict.fromkeys(["count_reflection", *(f.removesuffix("_norm") for f in features_of(canton, "dtw"))]))
    some = members(spark, sf_dir, canton)
    series = features.series(features.counts_per_unit(_half_events(spark, sf_dir).join(some, "student", "left_semi"), "semester", unit), "semester", unit, names)
    measures = regularity.regularity(logs.order_log(spark, sf_dir).join(some, "student", "left_semi"), _order_years(spark, sf_dir))
    measures = measures.drop("semester").withColumnRenamed("semester_aux", "semester").select(*keys, *features_of(canton, "euclidean"))
    rows = series.join(measures, keys, "left").withColumn("t", calendar.semester_id(F.col("school_year"), F.col("semester")).cast("long"))
    latest = cohort.first_per_key(rows, ["student", "t"], [F.desc("calendar_year")])
    every = some.withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))))
    return every.join(latest, ["student", "t"], "left").withColumn("g", F.lit(10 * canton) + F.col("t"))


def feature_rows(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, Callable[[DataFrame], DataFrame]]]:
    """``g, student, feature, v`` of each canton's series and of its numbers, each with what makes their distances."""
    parts = []
    for canton, (unit, _) in CANTONS.items():
        wide = checkpointed(semester_rows(spark, sf_dir, canton))
        bucket = f"semester_{unit}"
        parts.append((study.dense_features(wide, features_of(canton, "dtw"), bucket, CAPACITY[bucket]), study.feature_distances))
        parts.append((study.number_rows(wide, features_of(canton, "euclidean")), study.number_distances))
    return parts


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all features of both cantons in all semesters, over every window."""
    return checkpointed(reduce(DataFrame.unionByName, [make(rows) for rows, make in feature_rows(spark, sf_dir)]))


def different(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``distances`` of the students whose series is the first of its kind, ``g, feature, student, name``: which of these each student is like, and the
    numbers of all students, whose kernels need no distances."""
    members, parts, numbers = [], [], []
    for rows, make in feature_rows(spark, sf_dir):
        if make is study.number_distances:
            numbers.append(checkpointed(rows))
            continue
        named = checkpointed(distance.alike(checkpointed(rows), ["g", "feature"], "student", "v"))
        members.append(named.select("g", "feature", "student", "name"))
        parts.append(make(named.filter("student = name").select("g", "student", "feature", "v")))
    return checkpointed(reduce(DataFrame.unionByName, parts)), reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, numbers)


def each_canton(df: DataFrame, make: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``make`` over each canton's rows, put together."""
    return reduce(DataFrame.unionByName, [make(df.filter(F.expr(f"g div 10 = {c}")), c) for c in CANTONS])


def _shown(df: DataFrame) -> DataFrame:
    """The canton and the semester apart, modes as text."""
    rest = [F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) if c == "mode" else F.col(c) for c in df.columns if c != "g"]
    return _plain(df.select(F.expr("g div 10").alias("canton"), (F.col("g") % 10).alias("t"), *rest))


def _best(d: DataFrame, members: DataFrame, numbers: DataFrame) -> DataFrame:
    return study.best_cells(study.score_features(d, members).unionByName(study.score_numbers(numbers)))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel sums of each canton's groups of features, as matrices of students that are alike."""
    d, members, numbers = different(spark, sf_dir)
    best = checkpointed(_best(d, members, numbers))
    series = each_canton(d, lambda some, c: study.group_kinds(some, members, best, groups_of(c, "dtw")))
    return checkpointed(series.unionByName(each_canton(numbers, lambda some, c: study.number_kinds(some, best, groups_of(c, "euclidean")))))


def _profiles(labels: DataFrame) -> DataFrame:
    return _shown(study.profiles(labels, list(FEATURE_GROUPS), PROFILE_CLUSTERS))


@query()
def feature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best window, width and number of clusters of each canton, semester and feature, over the whole grids."""
    return _shown(_best(*different(spark, sf_dir)))


@query()
def study_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study: features, groups, and profiles over the groups' labels."""
    return _profiles(study.best_labels(study.search_kinds(_kinds(spark, sf_dir)), "feature_group"))


@query()
def study_adaptive_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study with clusters smoothed over the six semesters before the profiles are made."""
    kinds = _kinds(spark, sf_dir)
    labels = study.evolve_kinds(kinds, study.search_kinds(kinds))
    return _profiles(labels.select((F.col("g") * 10 + F.col("t")).alias("g"), "feature_group", "student", "label"))

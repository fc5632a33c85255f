"""Cohorts, first rows per key, and the feature matrices of a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import WRITE_R, WRITE_R_IMAGE
from .calendar import semester_id


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which should end in a tie-breaking column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def latest_per_key(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key: the one with the largest ``by``, by an aggregate that combines in tasks first."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(F.col(by), *[F.col(c) for c in rest if c != by])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(by)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def active_cohort(events: DataFrame, years: DataFrame, users: DataFrame, gender: DataFrame, excluded: list[int], *,
                  canton: str | None = None, types: tuple[str, ...] = WRITE_R_IMAGE) -> DataFrame:
    """Students of a canton (None: of all) with at least one event of ``types``, images included: the latest calendar year per school
    year. Grades and groups do not matter. A null canton is left out where one is asked for."""
    counts = events.groupBy("student", "calendar_year").agg(F.count_if(F.col("event_type").isin(*types)).alias("number_events"))
    df = (
        years.join(users.withColumn("student", F.col("user_id")), "student", "left")
        .join(gender.withColumnRenamed("user_id", "student"), "student", "left")
        .join(counts, ["student", "calendar_year"], "left")
    )
    chosen = (F.col("number_events") >= 1) & ~F.col("user_id").isin(excluded)
    df = df.filter(chosen & (F.col("canton") == canton) if canton else chosen)
    return first_per_key(df, ["student", "school_year"], [F.desc_nulls_first("calendar_year"), F.asc("number_events")])


def report_cohort(events: DataFrame, years: DataFrame, users: DataFrame, grades: DataFrame, gender: DataFrame, excluded: list[int],
                  types: tuple[str, ...] = WRITE_R, *, canton: str | None = None) -> DataFrame:
    """Graded students outside the group ``block`` with at least one event of ``types``: the latest calendar year
    per school year, with ``group_info`` and ``sum_medias``. A null group is left out too, as ``!=`` leaves it. This is the rule where schools
    hand in grades; ``active_cohort`` is the one where they do not."""
    counts = events.groupBy("student", "calendar_year").agg(F.count_if(F.col("event_type").isin(*types)).alias("number_events"))
    person = [F.col("user_id").alias("student"), F.col("user_id"), *([F.col("canton")] if canton else [])]
    df = (
        years.join(users.select(*person), "student", "left")
        .join(gender.withColumnRenamed("user_id", "student"), "student", "left")
        .join(counts, ["student", "calendar_year"], "left")
        .join(grades, ["student", "calendar_year", "school_year"], "left")
    )
    chosen = (F.col("number_events") >= 1) & (F.col("school_group") != "block") & F.col("final_grade").isNotNull()
    if canton:
        chosen = chosen & (F.col("canton") == canton)
    df = df.filter(chosen & ~F.col("user_id").isin(excluded)).withColumns(
        {"sum_medias": F.col("media1") + F.col("media2"), "group_info": F.coalesce("school_group", F.lit("no_group"))}
    )
    return first_per_key(df, ["student", "school_year"], [F.desc_nulls_first("calendar_year"), F.asc("number_events")])


def with_all_years(report: DataFrame, seen: DataFrame, years: int = 3) -> DataFrame:
    """Rows of ``report`` whose student has ``years`` distinct school years in ``seen``."""
    whole = seen.groupBy("student").agg(F.count_distinct("school_year").alias("_n")).filter(F.col("_n") == years)
    return report.join(whole, "student", "left_semi")


def feature_matrix(cohort: DataFrame, series: DataFrame, measures: DataFrame | None, period: str, year: int, *, years: DataFrame | None = None,
                   gender: DataFrame | None = None, grades: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Cohort x period: the series of one school year or semester (by its running number), the regularity measures, and, where given, the
    columns of ``years`` (school years), ``gender``, ``grades`` and ``extra`` (out-of-group measures).

    ``series`` is keyed by student, calendar and school year (and ``semester``), ``measures`` and ``extra`` likewise, in a semester by its running
    number. Of several calendar years of one school year the latest stands. Semesters start from the series, school
    years from ``years``; a student of the cohort without a row has nulls.
    """
    half, keys = period == "semester", ["student", "calendar_year", "school_year"]
    number = semester_id(F.col("school_year"), F.col("semester")) if half else F.col("school_year")
    if half:
        rows = series.withColumn("semester_id", number)
        rows = rows.join(years, keys, "left") if years is not None else rows
    else:
        rows = years.join(series, keys, "left") if years is not None else series
    rows = rows.filter((F.col("semester_id") if half else number) == year)
    rows = first_per_key(rows, ["student"], [F.desc_nulls_first("calendar_year")])
    if grades is not None:
        rows = rows.join(grades, keys, "left").withColumn("sum_medias", F.col("media1") + F.col("media2"))
    if gender is not None:
        rows = rows.join(gender.withColumnRenamed("user_id", "student"), "student", "left")
    out = cohort.select("student").distinct().join(rows, "student", "left")
    # The running number of a semester is called ``semester`` in the tables of measures.
    known = ["student", "calendar_year", *(["semester_id"] if half else ["school_year"])]
    for side in (measures, extra):
        if side is None:
            continue
        side = side.withColumnRenamed("semester", "semester_id").drop("semester_aux", "school_year") if half else side
        out = out.join(side, known, "left")
    return out


def whole_matrix(cohort: DataFrame, series: DataFrame, *, users: DataFrame, gender: DataFrame, grades: DataFrame) -> DataFrame:
    """All school years of the cohort with series counted from the study's begin: one row per student and school year, the latest calendar
    year, with the person's columns and each student's mean grades over all years."""
    marks = ["media1", "media2", "grade1", "grade2", "final_grade"]
    means = grades.groupBy("student").agg(*(F.avg(c).alias(c) for c in marks if c in grades.columns))
    rows = first_per_key(series, ["student", "school_year"], [F.desc_nulls_first("calendar_year")]).join(cohort.select("student").distinct(), "student", "left_semi")
    people = users.withColumnRenamed("user_id", "student")
    rows = rows.join(people, "student", "left").join(gender.withColumnRenamed("user_id", "student"), "student", "left")
    return rows.join(means, "student", "left").withColumn("sum_medias", F.col("media1") + F.col("media2"))


def feature_labels(cohort: DataFrame, labels: DataFrame, experiments: list[str]) -> DataFrame:
    """Cohort with one column of labels for each experiment, from one pivot of the label table."""
    wide = labels.filter(F.col("experiment").isin(experiments)).groupBy("student").pivot("experiment", experiments).agg(F.first("label"))
    return cohort.select("student").distinct().join(wide, "student", "left")


def latest_versions(events: DataFrame, activities: DataFrame, subject: str) -> DataFrame:
    """The latest recipe event of each activity with its ``tags``, ``ingredients``, ``title`` or ``description``."""
    recipes = events.filter(F.col("event_type").isin("write new recipe", "edit recipe")).withColumn("activity", F.col("attributes.activity"))
    latest = first_per_key(recipes, ["activity"], [F.desc_nulls_last("event_date"), F.asc("student")])
    if subject in ("title", "description"):
        return latest.select("student", "activity", "event_date", F.col(f"attributes.{subject}").alias(subject))
    side = activities.select(F.col("activity").cast("string").alias("activity"), subject)
    return latest.join(side, "activity").select("student", "activity", "event_date", subject)


def densify(domain: DataFrame, facts: DataFrame, keys: list[str], fill: dict[str, float]) -> DataFrame:
    """Every row of ``domain`` with its facts, filled where there are none."""
    return domain.distinct().join(facts, keys, "left").na.fill(fill)

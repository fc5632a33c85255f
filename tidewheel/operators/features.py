"""Measures per student, period and time bucket, their sums per period, and their sparse series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import EDIT_R, EXPERIENCE, NEW, NEW_R, PERIOD_KEYS, RECIPE, REFLECTION, WRITE, WRITE_R, time_unit
from .calendar import with_buckets
from .events import session_ids, session_stats

_TEXTS = ("improvement", "critical_point", "skill_documentation", "learning_budget")
#: Series of the third feature table by the measure they hold.
SERIES = (
    "count_reflection", "tags_ratio", "ingredients_ratio", "image_events", "image_ratio", "editing_ratio",
    "response_request_ratio", "request_feedback_ratio", "average_duration_session", "total_duration", "average_reflection",
    "average_description", "writing_events", "count_feedback", "quality_reflection", "new_recipe_duration", "recipe_image_ratio",
    "recipe_experience_ratio", "distinct_events", "count_just_log_in", "ratio_just_log_in", "total_events", "experience_events",
    "recipe_events", "reflection_events", "new_events", "editing_events",
)


def prepared(events: DataFrame, years: DataFrame, activities: DataFrame | None = None) -> DataFrame:
    """Events with session, clamped duration (2..120 minutes), tag and ingredient flags, school year and buckets.

    ``events`` carries the attribute struct; ``activities(activity, tags, ingredients)`` may fan out. A flag needs more
    than one tag or ingredient. Events without a school year of 1 or more are left out.
    """
    df = session_ids(events).join(years.select("student", "calendar_year", "school_year"), ["student", "calendar_year"], "left")
    df = df.withColumn("activity", F.col("attributes.activity"))
    if activities is not None:
        side = activities.select(F.col("activity").cast("string").alias("_activity"), "tags", "ingredients")
        df = df.join(side, F.col("activity") == F.col("_activity"), "left").drop("_activity")
    else:
        none = F.lit(None).cast("array<string>")
        df = df.withColumns({"tags": none, "ingredients": none})
    minutes = F.col("attributes.duration")
    return with_buckets(
        df.withColumns(
            {
                "image": F.coalesce(F.col("attributes.image"), F.lit(False)).cast("int"),
                "bool_tags": F.coalesce(F.cardinality("tags") > 1, F.lit(False)).cast("int"),
                "bool_ingredients": F.coalesce(F.cardinality("ingredients") > 1, F.lit(False)).cast("int"),
                "duration": F.least(F.greatest(F.coalesce(minutes, F.lit(2.0)), F.lit(2.0)), F.lit(120.0)),
            }
        ).drop("semester")
    ).filter("school_year > 0")


def _of(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def _ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0 or null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def measures() -> dict[str, Column]:
    """The event measures as aggregates: counts, conditional sums, and ratios that are null without a base."""
    n = {k: F.count_if(_of(*t)) for k, t in {
        "image": ("add image",), "write": WRITE, "write_r": WRITE_R, "experience": EXPERIENCE, "recipe": RECIPE, "reflection": REFLECTION,
        "new_r": NEW_R, "new": NEW, "edit_r": EDIT_R, "asked": ("request feedback",), "given": ("receive feedback",),
        "new_reflection": ("write new reflection",), "new_recipe": ("write new recipe",),
    }.items()}
    worked = F.count_distinct(F.when(_of(*WRITE), F.col("activity")))
    written = F.sum(sum((F.coalesce(F.length(f"attributes.{t}"), F.lit(0)) for t in _TEXTS), F.lit(0)))
    described = F.sum(F.coalesce(F.length("attributes.description"), F.lit(0)))
    return {
        "tags_ratio": _ratio(F.sum(F.when(_of(*WRITE), F.col("bool_tags"))), n["write"]),
        "ingredients_ratio": _ratio(F.sum(F.when(_of(*RECIPE), F.col("bool_ingredients"))), n["recipe"]),
        "image_events": n["image"], "image_ratio": _ratio(n["image"], worked), "writing_events": n["write"],
        "writing_events_with_reflection": n["write_r"], "total_events": F.count("*"), "experience_events": n["experience"],
        "recipe_events": n["recipe"], "reflection_events": n["reflection"], "new_events": n["new_r"], "editing_events": n["edit_r"],
        "editing_ratio": _ratio(n["edit_r"], n["write_r"]),
        "distinct_events": F.count_distinct(F.when(~_of("log in", "be inactive"), F.col("event_type"))),
        "recipe_image_ratio": _ratio(F.sum(F.when(_of(*WRITE), F.col("image"))), n["write"]),
        "new_recipe_duration": F.sum(F.when(_of("write new recipe"), F.col("duration"))),
        "count_reflection": n["reflection"], "count_feedback": F.count_if(_of("receive feedback", "request feedback")),
        "count_feedback_requests": n["asked"], "count_feedback_responses": n["given"],
        "request_feedback_ratio": _ratio(n["asked"], n["new"]), "response_request_ratio": _ratio(n["given"], n["asked"]),
        "quality_reflection": written, "average_reflection": _ratio(written, n["new_reflection"]),
        "average_description": _ratio(described, n["new_recipe"]),
        "recipe_experience_ratio": _ratio(n["recipe"], n["write"]), "experience_recipe_ratio": _ratio(n["experience"], n["write"]),
    }


def counts_per_unit(ready: DataFrame, period: str = "yearly", unit: str = "woy") -> DataFrame:
    """Session and event measures of ``prepared`` events per student, period and bucket.

    A session's bucket and year are each the largest among its events, so either side can have buckets that the
    other lacks: a full outer join.
    """
    bucket, keys = time_unit(period, unit), ["student", *PERIOD_KEYS[period]]
    sessions = session_stats(ready, keys=(bucket, "calendar_year", "school_year", "semester"))
    alone, n = F.count_if(F.col("session_events") == 1), F.count("*")
    total = F.sum(F.coalesce("session_duration", F.lit(0.0)))
    by_session = sessions.groupBy(*keys, bucket).agg(
        alone.alias("count_just_log_in"), (alone / n).alias("ratio_just_log_in"), (total / n).alias("average_duration_session"),
        total.alias("total_duration"),
    )
    by_event = ready.groupBy(*keys, bucket).agg(*(c.alias(k) for k, c in measures().items()))
    return by_event.join(by_session, [*keys, bucket], "full_outer")


def aggregated_per_period(counts: DataFrame, period: str = "yearly", unit: str = "woy") -> DataFrame:
    """Sums over the period's buckets, their decimal logarithms, and averages over the period's largest bucket."""
    bucket, keys = time_unit(period, unit), PERIOD_KEYS[period]
    names = ("count_feedback", "count_feedback_requests", "count_feedback_responses", "writing_events", "total_duration")
    sums = counts.groupBy("student", *keys).agg(
        F.sum(F.when(F.col("count_feedback_requests") > 0, 1).otherwise(0)).alias("sum_bool_feed"),
        *(F.sum(c).alias(f"sum_{c}") for c in names), F.max(bucket).alias("_last"),
    )
    # One row per period: joined back, so that no window holds a period's students in one task.
    ends = sums.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("_last").alias("_max"))
    top = sums.join(ends, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")

    def log(c: str) -> Column:
        return F.log10(F.col(f"sum_{c}") + F.lit(1e-7))

    return top.select(
        "student", *keys, "sum_bool_feed", _ratio(F.col("sum_bool_feed"), F.col("_max")).alias("feedback_ratio_bool"),
        *(f"sum_{c}" for c in names),
        F.when(F.col("sum_count_feedback") == 0, 0.0).otherwise(F.log10("sum_count_feedback")).alias("log_count_feedback"),
        *(log(c).alias(f"log_{c}") for c in names[1:]),
        _ratio(F.col("sum_total_duration"), F.col("_max")).alias("average_total_duration"),
        _ratio(F.col("sum_writing_events"), F.col("_max")).alias("average_writing_events"),
    )


def series(counts: DataFrame, period: str = "yearly", unit: str = "woy", names: tuple[str, ...] = SERIES) -> DataFrame:
    """Per student and period, each measure's values and buckets as two arrays in order of bucket, in one shuffle.

    Nulls are skipped; a measure without a value has null arrays. Students and periods without any
    ``count_reflection`` vanish. ``recipe_experience_ratio`` is the difference of the two shares.
    """
    bucket, keys = time_unit(period, unit), ["student", *PERIOD_KEYS[period]]
    value = {n: F.col(n).cast("double") for n in names}
    if "recipe_experience_ratio" in value:
        value["recipe_experience_ratio"] = F.col("recipe_experience_ratio") - F.col("experience_recipe_ratio")
    pairs = counts.groupBy(*keys).agg(
        F.count("count_reflection").alias("_n"),
        *(
            F.array_sort(F.collect_list(F.when(F.col(n).isNotNull(), F.struct(F.col(bucket).cast("int").alias("t"), v.alias("v"))))).alias(n)
            for n, v in value.items()
        ),
    ).filter("_n > 0")

    def side(n: str, field: str) -> Column:
        return F.when(F.size(n) > 0, F.transform(n, lambda x: x[field]))

    cols = [c for n in names for c in (side(n, "v").alias(n), side(n, "t").alias(f"{n}_{bucket}"))]
    norm = [
        c for n in ("total_duration", "writing_events") if n in names
        for c in (side(n, "v").alias(f"{n}_norm"), side(n, "t").alias(f"{n}_norm_{bucket}"))
    ]
    return pairs.select(*keys, *cols, *norm)


def feature_tables(ready: DataFrame, period: str, unit: str) -> dict[str, DataFrame]:
    """The three tables of one period and unit; the last has the sums beside the series."""
    counts = counts_per_unit(ready, period, unit)
    sums = aggregated_per_period(counts, period, unit)
    return {"counts": counts, "aggregated": sums, "dtw": series(counts, period, unit).join(sums, ["student", *PERIOD_KEYS[period]], "left")}


def dense(values: Column, buckets: Column, size: int) -> Column:
    """A sparse series as ``size`` doubles, 0 where it has none; buckets outside are dropped."""
    lookup = F.map_from_entries(
        F.array_distinct(F.transform(F.arrays_zip(buckets.alias("t"), values.alias("v")), lambda x: F.struct(x["t"], x["v"])))
    )
    # The lookup is the one element of an array, so that it is made once a series and not once a slot.
    return F.transform(F.array(lookup), lambda m: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))[0]


def out_of_range(buckets: Column, size: int) -> Column:
    """How many buckets a dense series of ``size`` would drop."""
    return F.size(F.filter(buckets, lambda t: (t < 0) | (t >= size)))

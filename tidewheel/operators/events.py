"""The unified event log: entities, event arms, gaps, inactivity, sessions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import STAFF_NOTIFICATIONS
from ..sources import checkpointed
from .calendar import log_semester, school_label

#: The attributes of all event types as one nullable struct: unlike a map or a variant it can be de-duplicated.
ATTRIBUTES = {
    "activity": "string", "session_id": "int", "title": "string", "description": "string", "start_date": "timestamp",
    "end_date": "timestamp", "duration": "double", "au_evaluation": "string", "number_of_updates": "int", "image": "boolean",
    "image_name": "string", "operation": "string", "improvement": "string", "critical_point": "string",
    "skill_documentation": "string", "learning_budget": "string", "sender": "long", "recipient": "long", "url": "string",
    "is_read": "boolean", "event_type": "string", "maximum": "double", "minutes": "double",
}


def attributes(df: DataFrame, **given: Column) -> Column:
    """The attribute struct from equally named columns of ``df`` and from ``given``; what is in neither is null."""
    have = set(df.columns)
    values = [
        given[k] if k in given else F.col(k) if k in have and k not in ("event_type",) else F.lit(None) for k in ATTRIBUTES
    ]
    return F.struct(*(v.cast(t).alias(k) for v, (k, t) in zip(values, ATTRIBUTES.items(), strict=True)))


def union_distinct(arms: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, arms).distinct()


def students(users_types, users, users_classes, communication_users, gender, grades, excluded: list[int]) -> DataFrame:
    """Students by type, and graded persons that are not among the ``excluded`` ids (which bind the graded ones only)."""
    graded = grades.select("user_id").distinct().withColumn("_graded", F.lit(True))
    joined = users_types
    for other in (users, users_classes, communication_users, gender, graded):
        joined = joined.join(other, "user_id", "left")
    chosen = (F.col("user_type") == "studente") | (F.coalesce("_graded", F.lit(False)) & ~F.col("user_id").isin(excluded))
    return joined.filter(chosen).select(
        F.col("user_id").alias("student"), F.when(F.col("language") == "ita", 1).otherwise(0).alias("language_ita"),
        F.when(F.col("canton") == "ti", "ticino").otherwise("geneva").alias("canton"), "archived", "number_of_classes",
        "number_of_communications", "total_reads", "gender",
    )


def staff(users_types: DataFrame, users: DataFrame, role: str) -> DataFrame:
    """Teachers (``docente``) or supervisors (``formatore``)."""
    return users_types.join(users, "user_id", "left").filter(F.col("user_type") == role).select(
        F.col("user_id").alias("person"), "language", "canton", "archived"
    )


def activities(activities_users: DataFrame, *others: DataFrame) -> DataFrame:
    """The activity table with all its satellites; an activity with several satellite rows fans out."""
    return reduce(lambda a, b: a.join(b, "activity", "left"), others, activities_users)


def student_events(
    activities_users, log_activities_duration, logins, reflections, feedback, requests, log_activities, users_no_dup, known, *,
    bad_days: tuple[str, ...] = (), first_year: int | None = None, last_year: int | None = None, tie: tuple[str, ...] = (),
) -> DataFrame:
    """The unified log of students. Recipe and experience arms, and both reflection arms, each come from one scan.

    Of several rows of one image the earliest stands, then that of the smallest person, then by the columns ``tie``.
    """
    kind = F.when(F.col("activity_type") == F.array(F.lit("recipe")), "recipe").when(
        F.col("activity_type") == F.array(F.lit("experience")), "experience"
    )
    verb = F.when(F.col("session_id") == 1, "write new ").when(F.col("session_id") > 1, "edit ")
    work = log_activities_duration.join(activities_users, "activity", "left").withColumn("_type", F.concat(verb, kind))
    back = reflections.withColumn("_type", F.concat(verb, F.lit("reflection")))
    shots = log_activities.join(activities_users, "activity", "left").filter("image = 1 and user_id > 0")
    shots = shots.filter(~F.to_date("event_date").cast("string").isin(*bad_days)) if bad_days else shots
    order = Window.partitionBy("activity", "image_name").orderBy(F.asc_nulls_last("event_date"), F.asc_nulls_last("user_id"), *tie)
    shots = shots.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("image")
    asked = requests.withColumn("duration", (F.unix_micros(F.col("end_date").cast("timestamp")) - F.unix_micros(F.col("start_date").cast("timestamp"))) / 60e6)

    def arm(df: DataFrame, person: str, kind: Column, ts: str) -> DataFrame:
        return df.filter(kind.isNotNull()).select(
            F.col(person).cast("int").alias("student"), kind.alias("event_type"), F.col(ts).cast("timestamp").alias("event_date"),
            attributes(df).alias("attributes"),
        )

    events = union_distinct(
        [
            arm(work, "user_id", F.col("_type"), "end_date"), arm(logins.select("user_id", "event_date"), "user_id", F.lit("log in"), "event_date"),
            arm(back, "student", F.col("_type"), "event_date"), arm(feedback, "student", F.lit("receive feedback"), "event_date"),
            arm(asked, "sender", F.lit("request feedback"), "end_date"), arm(shots, "user_id", F.lit("add image"), "event_date"),
        ]
    )
    events = events.join(known.select("student").distinct(), "student", "left_semi")
    if bad_days:
        events = events.filter(~F.to_date("event_date").cast("string").isin(*bad_days))
    one = events.join(users_no_dup, F.col("student") == F.col("us_user"), "left")
    return one.select(
        F.col("id_user").alias("student"), "event_type", "event_date", "attributes",
        school_label(F.col("event_date"), first_year, last_year).alias("calendar_year"), log_semester(F.col("event_date")).alias("semester"),
    )


def staff_events(notifications, activities_users, activities_responsables, logins, known) -> DataFrame:
    """The unified log of teachers or supervisors: one join of the notifications, then a branch on their type."""
    n, au, ar = notifications.alias("n"), activities_users.alias("au"), activities_responsables.alias("ar")
    text = F.col("n.activity").cast("string")
    joined = n.join(
        au, (text == F.col("au.activity").cast("string")) & (F.col("n.recipient") == F.col("au.user_id")), "left"
    ).join(ar, (text == F.col("ar.activity").cast("string")) & (F.col("n.sender") == F.col("ar.responsable")), "left")
    kind, person = F.lit(None).cast("string"), F.lit(None).cast("int")
    for t, (name, side) in STAFF_NOTIFICATIONS.items():
        kind = F.when(F.col("n.type") == t, name).otherwise(kind)
        person = F.when(F.col("n.type") == t, F.col(f"n.{side}").cast("int")).otherwise(person)
    noted = joined.select(
        person.alias("person"), kind.alias("event_type"), F.col("n.event_date").alias("event_date"),
        F.struct(
            F.col("n.notification").cast("string").alias("notification"), F.col("n.recipient").cast("long").alias("recipient"),
            F.col("n.sender").cast("long").alias("sender"), F.col("n.url").alias("url"), F.col("n.is_read").alias("is_read"),
            text.alias("activity"), F.col("n.description").alias("description"),
        ).alias("attributes"),
    ).filter("event_type is not null")
    seen = logins.select(F.col("user_id").cast("int").alias("person"), F.lit("log in").alias("event_type"), "event_date",
                         F.lit(None).cast(noted.schema["attributes"].dataType).alias("attributes"))
    # The date is cut after the duplicates have gone.
    both = union_distinct([noted, seen]).join(known.select("person").distinct(), "person", "left_semi")
    return both.withColumn("event_date", F.to_date("event_date"))


def inter_event_gaps(events: DataFrame, *, strict: bool = False, tie: str | None = None) -> DataFrame:
    """Adds ``previous`` (timestamp) and ``minutes`` since the previous event of the same student.

    ``strict``: a student's first event is measured against the last event of the student before it (ids ascending,
    null last), through a table of one row per student that is sorted in ranges, so that no task holds all of them.
    """
    order = [F.asc_nulls_last("event_date")] + ([F.asc_nulls_last(tie)] if tie else [])
    out = events.withColumn("previous", F.lag("event_date").over(Window.partitionBy("student").orderBy(*order)))
    if strict:
        before = _end_before(events).withColumnRenamed("student", "_who")
        out = out.join(before, F.col("student").eqNullSafe(F.col("_who")), "left")
        out = out.withColumn("previous", F.coalesce("previous", "_before")).drop("_who", "_before")
    return out.withColumn("minutes", (F.unix_micros(F.col("event_date").cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / 60e6)


def _end_before(events: DataFrame) -> DataFrame:
    """``student, _before``: the last event of the student before it, in order of id, null last.

    Students are sorted in ranges; a range's first one is measured against the last one of the ranges before it, of which the driver
    holds one row each.
    """
    ends = events.groupBy("student").agg(F.max("event_date").alias("_end"))
    order = F.asc_nulls_last("student")
    ranged = checkpointed(ends.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    last = F.max_by("_end", F.struct(F.col("student").isNull(), "student"))
    carried, at = {}, None
    for r in ranged.groupBy("_range").agg(last.alias("end")).orderBy("_range").collect():
        carried[r["_range"]], at = at, r.end
    w = Window.partitionBy("_range").orderBy(order)
    side = events.sparkSession.createDataFrame(list(carried.items()), f"_at int, _carried {ends.schema['_end'].dataType.simpleString()}")
    joined = ranged.join(F.broadcast(side), F.col("_range") == F.col("_at"), "left")
    return joined.select("student", F.when(F.row_number().over(w) == 1, F.col("_carried")).otherwise(F.lag("_end").over(w)).alias("_before"))


def upper_fences(gaps: DataFrame) -> DataFrame:
    """Per student and type: third quartile plus 1.5 interquartile ranges of the gaps, with discrete percentiles."""
    return gaps.groupBy("student", "event_type").agg(
        F.expr("percentile_disc(0.75) within group (order by minutes)").alias("q3"),
        F.expr("percentile_disc(0.25) within group (order by minutes)").alias("q1"),
    ).select("student", "event_type", (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("maximum"))


def inactivity(events: DataFrame, *, strict: bool = False, tie: str | None = None) -> DataFrame:
    """Rows ``be inactive`` three seconds after the event before a gap that is long for the student and the event's type."""
    gaps = inter_event_gaps(events, strict=strict, tie=tie)
    judged = gaps.join(upper_fences(gaps), ["student", "event_type"], "left")
    m = F.col("minutes")
    long_gap = ((m > F.col("maximum")) & (F.col("maximum") > 20)) | ((F.col("event_type") == "log in") & (m > 60)) | (m > 120)
    return judged.filter(long_gap)


def with_inactivity(events: DataFrame, **options) -> DataFrame:
    """The log with its inactivity rows (``attributes`` if the log has it, else null columns)."""
    idle = inactivity(events, **options)
    given = {
        "event_type": F.lit("be inactive"), "event_date": F.col("previous") + F.expr("interval 3 seconds"),
    }
    if "attributes" in events.columns:
        given["attributes"] = attributes(
            events.limit(0), event_type=F.col("event_type"), maximum=F.col("maximum"), end_date=F.col("event_date"),
            start_date=F.col("previous"), duration=F.col("minutes"), minutes=F.col("minutes"),
        )
    keep = {"student", "calendar_year", "semester", *given}
    idle = idle.select(*(given.get(c, F.col(c) if c in keep else F.lit(None).cast(events.schema[c].dataType)).alias(c) for c in events.columns))
    return events.unionByName(idle)


def session_ids(events: DataFrame) -> DataFrame:
    """Adds ``session``: inactivity rows of the student so far; rows of one moment share it."""
    w = Window.partitionBy("student").orderBy(F.asc_nulls_last("event_date"))
    return events.withColumn("session", F.sum((F.col("event_type") == "be inactive").cast("int")).over(w))


def session_stats(events: DataFrame, *, cap: float = 180.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per student and session: events, minutes from first to last (at most ``cap``), and the maxima of ``keys``."""
    span = (F.unix_micros(F.max(F.col("event_date").cast("timestamp"))) - F.unix_micros(F.min(F.col("event_date").cast("timestamp")))) / 60e6
    return events.filter("event_type != 'be inactive'").groupBy("student", "session").agg(
        F.count("*").alias("session_events"), *(F.max(k).alias(k) for k in keys), F.least(span, F.lit(cap)).alias("session_duration")
    )


def school_years(events: DataFrame, grades: DataFrame, types: tuple[str, ...], order: str = "calendar_year") -> DataFrame:
    """Rank of each calendar year in which a student wrote, replaced by the graded school year; years over 3 go.

    ``student_with_grades`` is 1 where there is no grade, as the published tables have it.
    """
    active = events.filter(F.col("event_type").isin(*types)).select("student", "calendar_year", *{order} - {"calendar_year"}).distinct()
    rank = F.row_number().over(Window.partitionBy("student").orderBy(F.asc_nulls_last(order)))
    ranked = active.withColumn("proxy_school_year", rank).join(
        grades.select("student", "calendar_year", F.col("school_year").alias("_graded")), ["student", "calendar_year"], "left"
    )
    return ranked.select(
        "student", "calendar_year", "proxy_school_year", F.coalesce("_graded", "proxy_school_year").alias("school_year"),
        F.col("_graded").isNull().cast("int").alias("student_with_grades"),
    ).filter("school_year <= 3")

"""Event logs, dimensions and grades over the driver's tables: the roles that the behaviour model needs.

Two logs: ``event_log`` from ``events`` (minutes apart, one month) and ``order_log`` from ``orders`` (days apart, seven years).
Kinds of events follow from the row's number, so that every measure has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import log_semester, school_label, school_start
from ..operators.events import attributes
from ..sources import table

KINDS = (
    "write new recipe", "edit recipe", "write new experience", "edit experience", "write new reflection", "edit reflection",
    "receive feedback", "request feedback", "log in", "add image", "log in",
)


def _kind(number):
    return F.element_at(F.array(*map(F.lit, KINDS)), (number % len(KINDS) + 1).cast("int"))


def _log(df: DataFrame) -> DataFrame:
    """From ``number, student, event_date, activity, duration, note`` to the unified log."""
    n, ts = F.col("number"), F.col("event_date")
    text = F.when(n % 5 != 0, F.expr("repeat('x', cast(number % 7 as int))"))
    return df.select(
        "number", "student", _kind(n).alias("event_type"), "event_date",
        attributes(
            df.select("activity", "duration"), image=n % 3 == 0, improvement=text, critical_point=F.col("note"),
            description=F.expr("repeat('d', cast(number % 13 as int))"),
        ).alias("attributes"),
        school_label(ts).alias("calendar_year"), school_start(ts).alias("school_start"), log_semester(ts).alias("semester"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return _log(
        e.select(
            F.col("event_id").alias("number"), F.col("user_id").alias("student"), F.col("ts").alias("event_date"),
            F.get_json_object("props", "$.k").alias("activity"), F.col("value").alias("duration"), F.col("props").alias("note"),
        )
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    seconds = F.make_dt_interval(secs=(F.col("o_orderkey") * 7919 % 86400).cast("decimal(18,6)"))
    return _log(
        o.select(
            F.col("o_orderkey").alias("number"), F.col("o_custkey").alias("student"),
            (F.col("o_orderdate").cast("timestamp_ntz") + seconds).alias("event_date"), (F.col("o_orderkey") % 97).cast("string").alias("activity"),
            (F.col("o_totalprice") % 200).alias("duration"), F.col("o_orderpriority").alias("note"),
        )
    )


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")

    def some(n):
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>"))

    return p.select(F.col("p_partkey").alias("activity"), some(F.col("p_size") % 4).alias("tags"), some(F.col("p_size") % 3).alias("ingredients"))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graded year for the customers of one segment: school year 2, group by number, balance as the final grade."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'FURNITURE'")
    group = F.when(F.col("c_custkey") % 3 == 0, "block").when(F.col("c_custkey") % 3 == 1, "a")
    return c.select(
        F.col("c_custkey").alias("student"), F.lit(9899).alias("calendar_year"), F.lit(2).alias("school_year"), group.alias("school_group"),
        F.col("c_acctbal").alias("media1"), (F.col("c_acctbal") / 2).alias("media2"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("final_grade"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons: type, language and canton by nation and segment."""
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "studente").when(F.col("c_mktsegment") == "MACHINERY", "docente").otherwise("formatore")
    return c.select(
        F.col("c_custkey").alias("user_id"), kind.alias("user_type"), F.when(F.col("c_nationkey") % 2 == 0, "ita").otherwise("fra").alias("language"),
        F.when(F.col("c_nationkey") % 3 == 0, "ti").otherwise("ge").alias("canton"), (F.col("c_acctbal") < 0).alias("archived"),
    )


def _cte(name: str, source: str, number: str, student: str, ts: str, activity: str, duration: str, note: str) -> str:
    kinds = " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS))
    return f"""{name}_raw as (select {number} as number, {student} as student, {ts} as event_date, {activity} as activity,
        {duration} as duration, {note} as critical_point from {source}),
    {name}_start as (select *, year((event_date - interval 1 microsecond)::date - interval 7 month) as school_start from {name}_raw),
    {name} as (select number, student, case number % {len(KINDS)} {kinds} end as event_type, event_date, activity, duration, critical_point,
        number % 3 = 0 as image, case when number % 5 <> 0 then repeat('x', (number % 7)::int) end as improvement,
        repeat('d', (number % 13)::int) as description, school_start,
        (school_start % 100) * 100 + (school_start + 1) % 100 as calendar_year,
        case when dayofyear(event_date) >= 214 or dayofyear(event_date) < 25 then 0 else 1 end as semester from {name}_start)"""


SQL_EVENT_LOG = _cte("elog", "events", "event_id", "user_id", "ts", "props ->> '$.k'", "value", "props")
SQL_ORDER_LOG = _cte(
    "olog", "orders", "o_orderkey", "o_custkey", "(o_orderdate + to_seconds(o_orderkey * 7919 % 86400))", "(o_orderkey % 97)::varchar",
    "o_totalprice % 200", "o_orderpriority",
)
SQL_ACTIVITIES = "acts as (select p_partkey::varchar as activity, p_size % 4 as tags, p_size % 3 as ingredients from part)"
SQL_GRADES = """grades as (select c_custkey as student, 9899 as calendar_year, 2 as school_year,
    case when c_custkey % 3 = 0 then 'block' when c_custkey % 3 = 1 then 'a' end as school_group, c_acctbal as media1, c_acctbal / 2 as media2,
    case when c_acctbal >= 0 then c_acctbal end as final_grade from customer where c_mktsegment = 'FURNITURE')"""
SQL_USERS = """people as (select c_custkey as user_id, case c_mktsegment when 'BUILDING' then 'studente' when 'MACHINERY' then 'docente'
    else 'formatore' end as user_type, case when c_nationkey % 2 = 0 then 'ita' else 'fra' end as language,
    case when c_nationkey % 3 = 0 then 'ti' else 'ge' end as canton, c_acctbal < 0 as archived from customer)"""

"""Queries over raw entity tables, cohorts and their feature matrices; their inputs are one SQL text for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, events, features, regularity
from ..sources import checkpointed, table
from . import logs, study
from .catalogue import _COHORT, _HALF, _KEYS, _half_events, _list, _order_years, _plain, _report, _sql, query
from .config import STAFF_NOTIFICATIONS, WRITE_R_IMAGE
from .regularity_sql import complete

#: Raw tables from the driver's, in words that both engines read; ``{x}`` names a driver's table.
RAW = {
    "users_types": """select c_custkey as user_id, case c_mktsegment when 'BUILDING' then 'studente' when 'MACHINERY' then 'docente'
        else 'formatore' end as user_type from {customer}""",
    "users": """select c_custkey as user_id, case when c_nationkey % 2 = 0 then 'ita' else 'fra' end as language,
        case when c_nationkey % 3 = 0 then 'ti' when c_nationkey = 4 then 'ge' else 'zh' end as canton, c_acctbal < 0 as archived from {customer} where c_custkey % 11 <> 0""",
    "residents": """select c_custkey as user_id, case when c_nationkey % 2 = 0 then 'ita' else 'fra' end as language,
        case when c_nationkey % 3 = 0 then 'ti' else 'ge' end as canton, c_acctbal < 0 as archived from {customer} where c_custkey % 11 <> 0""",
    "users_classes": "select c_custkey as user_id, c_custkey % 4 as number_of_classes from {customer} where c_custkey % 3 = 0",
    "communication_users": """select o_custkey as user_id, count(*) as number_of_communications, sum(o_orderkey % 5) as total_reads from {orders}
        where o_orderkey % 2 = 0 group by o_custkey""",
    "gender": "select c_custkey as user_id, case when c_custkey % 2 = 0 then 'f' else 'm' end as gender from {customer} where c_custkey % 5 <> 0",
    "all_grades": """select c_custkey as user_id, c_custkey as student, 9899 as calendar_year, 2 as school_year,
        case when c_custkey % 3 = 0 then 'block' when c_custkey % 3 = 1 then 'a' end as school_group, c_acctbal as media1, c_acctbal / 2 as media2,
        c_acctbal / 3 as grade1, c_acctbal / 4 as grade2, case when c_acctbal >= 0 then c_acctbal end as final_grade from {customer}
        where c_mktsegment = 'FURNITURE'
        union all select c_custkey, c_custkey, 9798, 1, 'a', 4.0, 5.0, null, 3.5, 4.5 from {customer} where c_custkey % 2 = 0""",
    "activities_users": """select p_partkey as activity, p_size * 7 % 150 + 1 as user_id, p_name as title, p_type as description, cast(p_size as string) as au_evaluation
        from {part}""",
    "activities_responsables": "select p_partkey as activity, p_size % 50 as responsable from {part} where p_partkey % 3 <> 1",
    "activities_companies": "select p_partkey as activity, p_brand as company from {part} where p_partkey % 4 = 0",
    "activities_versions": "select p_partkey as activity, 1 as version from {part} union all select p_partkey, 2 from {part} where p_partkey % 5 = 0",
    "activities_ingredients": "select p_partkey as activity, p_size % 3 as n_ingredients from {part} where p_partkey % 2 = 0",
    "activities_files": "select p_partkey as activity, p_name as file from {part} where p_partkey % 7 = 0",
    "activities_tags": "select p_partkey as activity, p_size % 4 as n_tags from {part} where p_size > 10",
    "log_activities_duration": """select o_orderkey % 97 + 1 as activity, cast(o_orderkey % 3 as int) as session_id,
        case o_orderkey % 5 when 0 then {other} when 1 then {recipe} when 2 then {recipe} else {experience} end as activity_type, o_orderdate as start_date,
        o_orderdate + interval 5 hour as end_date, o_totalprice as duration, cast(o_orderkey % 6 as int) as number_of_updates from {orders}""",
    "logins": "select cast(user_id as string) as user_id, ts as event_date from {events} where event_type in ('view', 'click')",
    "log_reflections": """select o_custkey % 150 + 1 as student, cast(o_orderkey % 4 as int) as session_id, o_orderdate as event_date, o_totalprice as duration,
        cast(o_orderkey % 97 as string) as activity, o_orderpriority as improvement from {orders} where o_orderstatus = 'F'""",
    "log_feedback": """select o_custkey % 150 + 1 as student, o_orderdate as event_date, cast(o_orderkey % 97 as string) as activity,
        o_orderdate + interval 2 hour as end_date, 7.5 as duration, o_custkey % 10 as sender from {orders} where o_orderstatus = 'O' and o_orderkey % 2 = 0""",
    "feedback_requests": """select cast(o_custkey % 150 + 1 as string) as sender, o_orderdate as start_date, o_orderdate + interval 90 minute as end_date,
        cast(o_orderkey % 97 as string) as activity, o_custkey % 10 as recipient, o_orderpriority as url, o_orderkey % 2 = 0 as is_read from {orders}
        where o_orderkey % 3 = 0""",
    "log_activities": """select o_orderkey % 97 + 1 as activity, cast(o_orderkey % 2 as int) as image, cast(o_orderkey % 40 as string) as image_name,
        o_orderstatus as operation, o_orderdate as event_date from {orders}""",
    "users_no_dup": """select cast(c_custkey as int) as us_user, cast(case when c_custkey % 10 = 0 then c_custkey + 1 else c_custkey end as int) as id_user from {customer}
        where c_custkey % 13 <> 0""",
    "notifications": """select o_orderkey as notification, case o_orderkey % 8 when 0 then 'feedback response' when 1 then 'communication' when 2 then 'feedback request'
        when 3 then 'classfile added' when 4 then 'new experience' when 5 then 'new recipe' else 'other' end as type, o_custkey as sender,
        o_orderkey % 50 as recipient, o_orderdate as event_date, o_orderpriority as url, o_orderkey % 3 = 0 as is_read, o_orderkey % 97 as activity,
        o_orderstatus as description from {orders}""",
}
_TABLES = ("customer", "orders", "part", "events")
BAD_DAY = "1996-07-02"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = RAW[name].replace("{recipe}", "array('recipe')").replace("{experience}", "array('experience')").replace("{other}", "array('a', 'b')")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in text})


def _raw_sql(*names: str) -> list[str]:
    lists = {"recipe": "['recipe']", "experience": "['experience']", "other": "['a', 'b']"}
    return [f"{n} as ({RAW[n].format(**lists, **{t: t for t in _TABLES})})" for n in names]


# --- entities --------------------------------------------------------------------------------------------------------

_TEST_IDS = [5, 10, 15, 20]
_PERSON = ("users_types", "users", "users_classes", "communication_users", "gender", "all_grades")


@query(_sql(_raw_sql(*_PERSON), """select user_id as student, coalesce((language = 'ita')::int, 0) as language_ita, case when canton = 'ti' then 'ticino' else 'geneva' end as canton,
    archived, number_of_classes, number_of_communications, total_reads::bigint as total_reads, gender from users_types left join users using (user_id)
    left join users_classes using (user_id) left join communication_users using (user_id) left join gender using (user_id) where user_type = 'studente'
    or (user_id in (select user_id from all_grades) and user_id not in (5, 10, 15, 20))"""),
    nullable=("number_of_classes", "number_of_communications", "total_reads"))
def students_entity_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(events.students(*(raw(spark, sf_dir, n) for n in _PERSON[:5]), raw(spark, sf_dir, "all_grades"), _TEST_IDS))


@query(_sql(_raw_sql("users_types", "users"), """select user_type, user_id as person, language, canton, archived from users_types left join users using (user_id)
    where user_type in ('docente', 'formatore')"""))  # fmt: skip
def staff_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = [raw(spark, sf_dir, n) for n in ("users_types", "users")]
    both = [events.staff(*people, role).withColumn("user_type", F.lit(role)) for role in ("docente", "formatore")]
    return both[0].union(both[1])


_HUB = ("activities_users", "activities_responsables", "activities_companies", "activities_versions", "activities_ingredients", "activities_files", "activities_tags")


@query(_sql(_raw_sql(*_HUB), "select * from activities_users " + " ".join(f"left join {n} using (activity)" for n in _HUB[1:])),
       nullable=("responsable", "version", "n_ingredients", "n_tags"))
def activities_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activity table with all six satellites, of which one fans out."""
    return _plain(events.activities(*(raw(spark, sf_dir, n) for n in _HUB)))


_ARMS = ("activities_users", "log_activities_duration", "logins", "log_reflections", "log_feedback", "feedback_requests", "log_activities", "users_no_dup")
_SHOWN = ("activity", "session_id", "title", "description", "start_date", "end_date", "duration", "au_evaluation", "number_of_updates", "image_name",
          "operation", "improvement", "sender", "recipient", "url", "is_read")


def _arm_sql(source: str, person: str, kind: str, ts: str, where: str, **given: str) -> str:
    types = {"session_id": "int", "start_date": "timestamp", "end_date": "timestamp", "duration": "double", "number_of_updates": "int", "sender": "bigint",
             "recipient": "bigint", "is_read": "boolean"}
    shown = ", ".join(f"({given.get(c, 'null')})::{types.get(c, 'varchar')} as {c}" for c in _SHOWN)
    return f"select ({person})::int as student, {kind} as event_type, {ts} as event_date, {shown} from {source} where {where}"


_DONE = {"activity": "activity", "session_id": "session_id", "title": "title", "description": "description", "start_date": "start_date", "end_date": "end_date",
         "duration": "duration", "au_evaluation": "au_evaluation", "number_of_updates": "number_of_updates"}
_BACK = {"activity": "activity", "session_id": "session_id", "duration": "duration", "improvement": "improvement"}
_WORK = "log_activities_duration left join activities_users using (activity)"
_LOG_ARMS = " union ".join(
    [
        _arm_sql(_WORK, "user_id", f"'{verb} {kind}'", "end_date", f"activity_type = ['{kind}'] and session_id {when}", **_DONE)
        for kind in ("recipe", "experience") for verb, when in (("write new", "= 1"), ("edit", "> 1"))
    ]
    + [
        _arm_sql("log_reflections", "student", f"'{verb} reflection'", "event_date", f"session_id {when}", **_BACK)
        for verb, when in (("write new", "= 1"), ("edit", "> 1"))
    ]
    + [
        _arm_sql("logins", "user_id", "'log in'", "event_date", "true"),
        _arm_sql("log_feedback", "student", "'receive feedback'", "event_date", "true", **{c: c for c in ("activity", "end_date", "duration", "sender")}),
        _arm_sql("feedback_requests", "sender", "'request feedback'", "end_date", "true", duration="90.0",
                 **{c: c for c in ("activity", "start_date", "end_date", "sender", "recipient", "url", "is_read")}),
        _arm_sql(f"""(select * from log_activities left join activities_users using (activity) where image = 1 and user_id > 0
            and event_date::date <> date '{BAD_DAY}' qualify row_number() over (partition by activity, image_name order by event_date, user_id, operation) = 1)""",
                 "user_id", "'add image'", "event_date", "true", **{c: c for c in ("activity", "title", "description", "au_evaluation", "image_name", "operation")}),
    ]
)


@query(_sql([*_raw_sql(*_ARMS), f"arms as ({_LOG_ARMS})",
             f"kept as (select * from arms where student in (select student from (select c_custkey as student from customer where c_custkey % 7 <> 3)) and event_date::date <> date '{BAD_DAY}')"],
    f"""select id_user as student, event_type, event_date, {", ".join(_SHOWN)},
    case when y between 1995 and 1999 then (y % 100) * 100 + (y + 1) % 100 end as calendar_year,
    case when dayofyear(event_date) >= 214 or dayofyear(event_date) < 25 then 0 else 1 end as semester
    from (select *, year((event_date - interval 1 microsecond)::date - interval 7 month) as y from kept) left join users_no_dup on student = us_user"""),
    nullable=("student", "session_id", "number_of_updates", "sender", "recipient", "calendar_year"))
def student_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten-arm log: images once, one day left out, persons renamed, each row with its attributes."""
    tables = {n: raw(spark, sf_dir, n) for n in _ARMS}
    known = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> 3").select(F.col("c_custkey").alias("student"))
    out = events.student_events(*tables.values(), known, bad_days=(BAD_DAY,), first_year=1995, last_year=1999, tie=("operation",))
    return _plain(out.select("student", "event_type", "event_date", *(F.col(f"attributes.{c}").alias(c) for c in _SHOWN), "calendar_year", "semester"))


_STAFF = ("notifications", "activities_users", "activities_responsables", "logins", "users_types")
_ACTS = ("notification", "recipient", "sender", "url", "is_read", "activity", "description")
_STAFF_ARMS = " union ".join(
    [
        f"""select n.{side}::int as person, '{name}' as event_type, n.event_date, n.notification::varchar as notification, n.recipient, n.sender, n.url, n.is_read,
        n.activity::varchar as activity, n.description from notifications n left join activities_users au on n.activity = au.activity and n.recipient = au.user_id
        left join activities_responsables ar on n.activity = ar.activity and n.sender = ar.responsable where type = '{kind}'"""
        for kind, (name, side) in STAFF_NOTIFICATIONS.items()
    ]
    + ["select user_id::int, 'log in', event_date, null, null, null, null, null, null, null from logins"]
)


@query(_sql([*_raw_sql(*_STAFF), f"acted as ({_STAFF_ARMS})"], f"""select person, event_type, event_date::date::varchar as event_date, {", ".join(_ACTS)} from acted
    where person in (select user_id from users_types where user_type <> 'studente')"""), nullable=("recipient", "sender"))  # fmt: skip
def staff_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six kinds of notifications and the logins of teachers and supervisors, row by row."""
    types = raw(spark, sf_dir, "users_types").filter("user_type != 'studente'").select(F.col("user_id").alias("person"))
    out = events.staff_events(*(raw(spark, sf_dir, n) for n in _STAFF[:4]), types)
    return _plain(out.select("person", "event_type", F.col("event_date").cast("string").alias("event_date"), *(F.col(f"attributes.{c}").alias(c) for c in _ACTS)))


# --- cohorts and their matrices --------------------------------------------------------------------------------------

_OTHER = [*_COHORT[:3], *_raw_sql("residents", "gender"),
    f"acts_of as (select student, calendar_year, count(*) filter (where event_type in ({_list(WRITE_R_IMAGE)})) as number_events from olog group by all)",
    """active as (select y.student, school_year, calendar_year, number_events, gender, canton, language from years y join residents on residents.user_id = y.student
    left join gender on gender.user_id = y.student left join acts_of using (student, calendar_year) where number_events >= 1 and canton = 'ge'
    and residents.user_id not in (5, 10, 15, 20) qualify row_number() over (partition by y.student, school_year order by calendar_year desc) = 1)"""]  # fmt: skip
_ACTIVE = ("student", "school_year", "calendar_year", "number_events", "gender", "canton", "language")


def _active(spark: SparkSession, sf_dir: str, users: str = "residents") -> DataFrame:
    """The active cohort among ``residents``, of whom all outside the first canton live in the second, or among ``users``."""
    people, gender = raw(spark, sf_dir, users), raw(spark, sf_dir, "gender")
    return cohort.active_cohort(logs.order_log(spark, sf_dir), _order_years(spark, sf_dir), people, gender, _TEST_IDS, canton="ge").select(*_ACTIVE)


@query(_sql(_OTHER, f"select {', '.join(_ACTIVE)} from active"))
def cohort_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort of the canton without grades: images count as events, no group or grade is asked for."""
    return _plain(_active(spark, sf_dir))


@query(_sql(_OTHER, f"""select {', '.join(_ACTIVE)} from active where student in (select student from active group by student
    having count(distinct school_year) = 3)"""))  # fmt: skip
def cohort_active_three_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _active(spark, sf_dir)
    return _plain(cohort.with_all_years(out, out))


@query(_sql([*_OTHER, *_COHORT[3:]], "select student from report union select student from active"))
def cohort_ids_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The students of either cohort, once each."""
    return _plain(_report(spark, sf_dir).select("student").union(_active(spark, sf_dir).select("student")).distinct())


_PLOT = ("writing_events", "total_duration", "distinct_events")
_PLOT_SQL = " union all ".join(f"select {_KEYS}, '{n}' as feature, semester_biweek as slot, {n}::double as x from kept where {n} is not null" for n in _PLOT)


@query(_sql([*_HALF, f"kept as (select * from counts where ({_KEYS}) in (select ({_KEYS}) from counts where count_reflection is not null))", f"each as ({_PLOT_SQL})",
             "upper as (select feature, case when quantile_cont(x, 0.9) = 0 then 1 else quantile_cont(x, 0.9) end as upper from each group by feature)",
             f"shown as (select {_KEYS}, feature from each where slot < 13 group by all having sum(x) > 0.01)"],
    f"""select {_KEYS}, feature, slot::bigint as slot, round(coalesce(x, 0), 6) as v, round(upper, 6) as upper from shown cross join (select unnest(range(13)) as slot)
    left join each using ({_KEYS}, feature, slot) join upper using (feature)"""))  # fmt: skip
def plot_ready_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense series with the limit up to which they are drawn."""
    counts = features.counts_per_unit(_half_events(spark, sf_dir), "semester", "biweek")
    wide = features.series(counts, "semester", "biweek", ("count_reflection", *_PLOT))
    return _plain(study.plot_series(wide, list(_PLOT), "semester_biweek", 13, ("student", "calendar_year", "school_year", "semester")))


_FEATURES = ("writing_events", "total_duration", "tags_ratio", "average_reflection")


def _flat(df: DataFrame, names: tuple[str, ...] = _FEATURES) -> DataFrame:
    """Each series as its length and sum."""
    total = {f"sum_{n}": F.aggregate(n, F.lit(0.0), lambda a, x: a + x) for n in names}
    return df.withColumns({f"n_{n}": F.size(n) for n in names} | total).withColumns({f"n_{n}": F.when(F.col(n).isNotNull(), F.col(f"n_{n}")) for n in names})


_FLAT = [f"{a}_{n}" for n in _FEATURES for a in ("n", "sum")]
_FLAT_SQL = ", ".join(f"nullif(count({n}), 0) as n_{n}, round(sum({n}), 6)::double as sum_{n}" for n in _FEATURES)
_FLAT_WHOLE = tuple(f"n_{n}" for n in _FEATURES)
_MARKS = ("media1", "media2", "grade1", "grade2", "final_grade", "sum_medias")
_MARKS_SQL = ", ".join(f"round({c}, 6) as {c}" for c in _MARKS)


def _semester_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = features.counts_per_unit(_half_events(spark, sf_dir), "semester", "biweek")
    return features.series(counts, "semester", "biweek", ("count_reflection", *_FEATURES))


@query(_sql([*_HALF, *_raw_sql("gender", "all_grades"), f"wide as (select {_KEYS}, {_FLAT_SQL} from counts group by all having count(count_reflection) > 0)",
             f"measures as ({complete(_KEYS)})", """picked as (select * from (select *, school_year * 2 + semester - 1 as semester_id from wide) left join years using (student,
             calendar_year, school_year) where semester_id = 3 qualify row_number() over (partition by student order by calendar_year desc) = 1)"""],
    f"""select w.student, p.calendar_year, p.school_year, p.semester_id, p.proxy_school_year, p.student_with_grades, {", ".join(_FLAT)}, gender, school_group, {_MARKS_SQL.replace("round(sum_medias, 6)", "round(media1 + media2, 6)")},
    m.pwd, m.phd, m.fdh, m.fwh, m.fwd, m.ws1 from (select distinct student from years) w left join picked p on p.student = w.student
    left join gender on gender.user_id = p.student left join all_grades g on g.student = p.student and g.calendar_year = p.calendar_year and g.school_year = p.school_year
    left join measures m on m.student = p.student and m.calendar_year = p.calendar_year and m.semester = p.semester_id"""),
    nullable=("calendar_year", "school_year", "semester_id", "proxy_school_year", "student_with_grades", *_FLAT_WHOLE))
def semester_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix of the third semester: series, years, gender, grades and regularity."""
    years = _order_years(spark, sf_dir)
    out = cohort.feature_matrix(
        years, _semester_series(spark, sf_dir), regularity.regularity(logs.order_log(spark, sf_dir), years), "semester", 3,
        years=years, gender=raw(spark, sf_dir, "gender"), grades=raw(spark, sf_dir, "all_grades").drop("user_id"),
    )
    shown = ["student", "calendar_year", "school_year", "semester_id", "proxy_school_year", "student_with_grades", *_FLAT, "gender", "school_group", *_MARKS]
    return _plain(_flat(out).select(*shown, "pwd", "phd", "fdh", "fwh", "fwd", "ws1"))


_YEAR = "student, calendar_year, school_year"


def _yearly_sql(unit: str) -> list[str]:
    from .catalogue import _counts_sql

    return [*_HALF[:-1], _counts_sql("calendar_year, school_year", unit), f"wide as (select {_YEAR}, {_FLAT_SQL} from counts group by all having count(count_reflection) > 0)"]


def _yearly_series(spark: SparkSession, sf_dir: str, unit: str, years: DataFrame | None = None) -> DataFrame:
    return features.series(features.counts_per_unit(_half_events(spark, sf_dir, years), "yearly", unit), "yearly", unit, ("count_reflection", *_FEATURES))


@query(_sql([*_yearly_sql("woy"), *_raw_sql("gender", "all_grades"), f"measures as ({complete(_YEAR)})",
             f"""extra as (select {_YEAR}, count(*) as out_events from olog join years using (student, calendar_year) group by all)""",
             f"""picked as (select * from years left join wide using ({_YEAR}) where school_year = 2
             qualify row_number() over (partition by student order by calendar_year desc) = 1)"""],
    f"""select w.student, p.calendar_year, p.school_year, p.proxy_school_year, p.student_with_grades, {", ".join(_FLAT)}, gender, school_group,
    {_MARKS_SQL.replace("round(sum_medias, 6)", "round(media1 + media2, 6)")}, m.pwd, m.pwd_biweek, m.phd, m.fdh, m.fwd, e.out_events from (select distinct student from years) w
    left join picked p on p.student = w.student left join gender on gender.user_id = p.student
    left join all_grades g on g.student = p.student and g.calendar_year = p.calendar_year and g.school_year = p.school_year
    left join measures m on m.student = p.student and m.calendar_year = p.calendar_year and m.school_year = p.school_year
    left join extra e on e.student = p.student and e.calendar_year = p.calendar_year and e.school_year = p.school_year"""),
    nullable=("calendar_year", "school_year", "proxy_school_year", "student_with_grades", "out_events", *_FLAT_WHOLE))
def yearly_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix of the second school year, with an out-of-group column."""
    years, log = checkpointed(_order_years(spark, sf_dir)), logs.order_log(spark, sf_dir)  # the years are read in six places
    extra = log.join(years.select("student", "calendar_year", "school_year"), ["student", "calendar_year"]).groupBy("student", "calendar_year", "school_year")
    out = cohort.feature_matrix(
        years, _yearly_series(spark, sf_dir, "woy", years), regularity.regularity(log, years, semesters=False), "yearly", 2, years=years,
        gender=raw(spark, sf_dir, "gender"), grades=raw(spark, sf_dir, "all_grades").drop("user_id"), extra=extra.agg(F.count("*").alias("out_events")),
    )
    shown = ["student", "calendar_year", "school_year", "proxy_school_year", "student_with_grades", *_FLAT, "gender", "school_group", *_MARKS]
    return _plain(_flat(out).select(*shown, "pwd", "pwd_biweek", "phd", "fdh", "fwd", "out_events"))


@query(_sql([*_yearly_sql("complete_biweek"), *_raw_sql("users", "gender", "all_grades"),
             f"means as (select student, {', '.join(f'avg({c}) as {c}' for c in _MARKS[:-1])} from all_grades group by student)",
             "picked as (select * from wide qualify row_number() over (partition by student, school_year order by calendar_year desc) = 1)"],
    f"""select p.student, p.school_year, p.calendar_year, {", ".join(_FLAT)}, language, canton, archived, gender,
    {_MARKS_SQL.replace("round(sum_medias, 6)", "round(media1 + media2, 6)")} from picked p left join users on users.user_id = p.student
    left join gender on gender.user_id = p.student left join means on means.student = p.student where p.student in (select student from years where school_year = 2)"""),
    nullable=_FLAT_WHOLE)
def complete_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All school years of those who reached the second, with mean grades."""
    second = _order_years(spark, sf_dir).filter("school_year = 2")
    out = cohort.whole_matrix(
        second, _yearly_series(spark, sf_dir, "complete_biweek"), users=raw(spark, sf_dir, "users"), gender=raw(spark, sf_dir, "gender"),
        grades=raw(spark, sf_dir, "all_grades").drop("user_id"),
    )
    return _plain(_flat(out).select("student", "school_year", "calendar_year", *_FLAT, "language", "canton", "archived", "gender", *_MARKS))

"""The event log: unions, gaps, fences, sessions and streams on hand-made rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewheel import streaming
from tidewheel.operators import events as ev
from tidewheel.operators import regularity

T0 = datetime(2019, 9, 2, 8)
LOG = "student int, event_type string, event_date timestamp_ntz, calendar_year int, semester int"


def log(spark, rows):
    return spark.createDataFrame([(s, k, T0 + timedelta(minutes=m) if m is not None else None, 1920, 0) for s, k, m in rows], LOG)


def test_session_ids_are_shared_by_ties(spark):
    df = log(spark, [(1, "be inactive", 0), (1, "be inactive", 0), (1, "log in", 5), (2, "log in", 1), (None, "log in", 3)])
    got = sorted((str(r.student), r.event_date, r.session) for r in ev.session_ids(df).collect())
    assert [x[2] for x in got] == [2, 2, 2, 0, 0]


def test_gaps_within_and_across_students(spark):
    df = log(spark, [(2, "log in", 100), (1, "log in", 0), (1, "log in", 30), (None, "log in", 400), (2, "log in", 170)])
    plain = {(r.student, r.event_date): r.minutes for r in ev.inter_event_gaps(df).collect()}
    strict = {(r.student, r.event_date): r.minutes for r in ev.inter_event_gaps(df, strict=True).collect()}
    at = lambda m: T0 + timedelta(minutes=m)
    assert plain == {(1, at(0)): None, (1, at(30)): 30, (2, at(100)): None, (2, at(170)): 70, (None, at(400)): None}
    assert strict == {(1, at(0)): None, (1, at(30)): 30, (2, at(100)): 70, (2, at(170)): 70, (None, at(400)): 230}


def test_inactivity_rules(spark):
    rows = [(1, "log in", 0), (1, "log in", 61), (1, "edit recipe", 62), (1, "edit recipe", 63), (1, "edit recipe", 64), (1, "add image", 300)]
    rows += [(2, "edit recipe", m) for m in (0, 1, 2, 3, 4, 5, 6, 60)]
    idle = ev.inactivity(log(spark, rows)).select("student", "event_type", "previous", "minutes", "maximum").collect()
    assert sorted((r.student, r.event_type, r.minutes) for r in idle) == [(1, "add image", 236.0), (1, "log in", 61.0)]
    whole = ev.with_inactivity(log(spark, rows))
    added = whole.filter("event_type = 'be inactive'").select("event_date").collect()
    assert sorted(r[0] for r in added) == [T0 + timedelta(seconds=3), T0 + timedelta(minutes=64, seconds=3)]
    assert whole.count() == len(rows) + 2


@pytest.mark.parametrize(("values", "q1", "q3"), [([1, 2, 3, 4], 1, 3), ([1, 2, 3, 4, 5], 2, 4)])
def test_discrete_percentiles(spark, values, q1, q3):
    gaps = spark.createDataFrame([(1, "x", float(v)) for v in values], "student int, event_type string, minutes double")
    assert ev.upper_fences(gaps).first().maximum == q3 + 1.5 * (q3 - q1)


def test_session_stats_cap_and_ignore_inactivity(spark):
    df = ev.session_ids(log(spark, [(1, "log in", 0), (1, "edit recipe", 200), (1, "be inactive", 201), (1, "log in", 300)]))
    got = sorted(tuple(r) for r in ev.session_stats(df).collect())
    assert got == [(1, 0, 2, 180.0), (1, 1, 1, 0.0)]


def test_school_years_are_overridden_by_grades(spark):
    df = spark.createDataFrame([(1, "edit recipe", y) for y in (1314, 1415, 1516, 1617)] + [(2, "log in", 1314)], "student int, event_type string, calendar_year int")
    grades = spark.createDataFrame([(1, 1415, 3)], "student int, calendar_year int, school_year int")
    got = sorted(tuple(r) for r in ev.school_years(df, grades, ("edit recipe",)).collect())
    assert got == [(1, 1314, 1, 1, 1), (1, 1415, 2, 3, 0), (1, 1516, 3, 3, 1)]


def test_student_events_from_raw_tables(spark):
    ts = lambda m: T0 + timedelta(minutes=m)
    users = spark.createDataFrame([(10, 1, "Pie", "d")], "activity int, user_id int, title string, description string")
    work = spark.createDataFrame(
        [(10, 1, ["recipe"], ts(0), ts(5), 5.0), (10, 2, ["experience"], ts(10), ts(12), 2.0), (10, 1, ["other"], ts(0), ts(1), 1.0), (10, 1, ["recipe"], ts(0), ts(5), 5.0)],
        "activity int, session_id int, activity_type array<string>, start_date timestamp, end_date timestamp, duration double",
    )
    logins = spark.createDataFrame([("1", ts(1)), ("9", ts(1))], "user_id string, event_date timestamp")
    back = spark.createDataFrame([(1, 1, ts(20), "good"), (1, 3, ts(21), None)], "student int, session_id int, event_date timestamp, improvement string")
    feed = spark.createDataFrame([(1, ts(30), "10")], "student int, event_date timestamp, activity string")
    asked = spark.createDataFrame([("1", ts(40), ts(43))], "sender string, start_date timestamp, end_date timestamp")
    shots = spark.createDataFrame([(10, 1, "a.png", ts(51)), (10, 1, "a.png", ts(50)), (10, 0, "b.png", ts(52)), (10, 1, "c.png", datetime(2020, 7, 2, 9))],
                                  "activity int, image int, image_name string, event_date timestamp")
    canonical = spark.createDataFrame([(1, 77)], "us_user int, id_user int")
    known = spark.createDataFrame([(1,)], "student int")
    out = ev.student_events(users, work, logins, back, feed, asked, shots, canonical, known, bad_days=("2020-07-02",), first_year=2013, last_year=2020)
    rows = out.collect()
    assert sorted(r.event_type for r in rows) == sorted(
        ["write new recipe", "edit experience", "log in", "write new reflection", "edit reflection", "receive feedback", "request feedback", "add image"]
    )
    assert {r.student for r in rows} == {77} and {r.calendar_year for r in rows} == {1920}
    by = {r.event_type: r.attributes for r in rows}
    assert by["request feedback"].duration == 3.0 and by["write new reflection"].improvement == "good" and by["write new recipe"].title == "Pie"


def test_staff_events_branch_on_type(spark):
    n = spark.createDataFrame(
        [(1, "communication", 5, 6, T0, "10"), (2, "feedback request", 7, 5, T0, "10"), (3, "other", 5, 5, T0, "10"), (4, "communication", 8, 6, T0, "10")],
        "notification int, type string, sender int, recipient int, event_date timestamp, activity string",
    ).withColumns({"url": F.lit("u"), "is_read": F.lit(True), "description": F.lit("d")})
    au = spark.createDataFrame([(10, 6)], "activity int, user_id int")
    ar = spark.createDataFrame([(10, 5)], "activity int, responsable int")
    logins = spark.createDataFrame([(5, T0), (5, T0), (5, T0 + timedelta(hours=1))], "user_id int, event_date timestamp")
    out = ev.staff_events(n, au, ar, logins, spark.createDataFrame([(5,)], "person int")).collect()
    assert sorted(r.event_type for r in out) == ["communicate", "log in", "log in", "receive feedback request"]
    assert {r.event_date for r in out} == {T0.date()}


def test_students_keep_graded_ones_but_excluded_ids(spark):
    types = spark.createDataFrame([(1, "studente"), (2, "docente"), (3, "docente"), (4, "studente")], "user_id int, user_type string")
    people = spark.createDataFrame([(i, "ita", "ti", False) for i in range(1, 5)], "user_id int, language string, canton string, archived boolean")
    extra = [spark.createDataFrame([], f"user_id int, {c}") for c in ("number_of_classes int", "number_of_communications int, total_reads int", "gender string")]
    grades = spark.createDataFrame([(2,), (3,), (3,), (4,)], "user_id int")
    out = ev.students(types, people, *extra, grades, [3, 4])
    assert sorted(r.student for r in out.collect()) == [1, 2, 4]


def run(query_df, name, spark):
    q = query_df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    schema = "student long, event_type string, event_date timestamp"
    rows = [(1, "edit recipe", T0 + timedelta(minutes=m)) for m in (0, 5, 200)] + [(1, "log in", T0 + timedelta(days=30))]
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log_ = streaming.read_log(spark, str(tmp_path / "in"), schema)
    counts = run(streaming.bucket_counts(log_), "counts", spark)
    assert [(r.total_events, r.writing_events) for r in counts] == [(3, 3)]
    ses = sorted((r.session_duration, r.session_events) for r in run(streaming.sessions(log_), "ses", spark))
    assert ses == [(0.0, 1), (5.0, 2)]
    idle = sorted(r.minutes for r in run(streaming.inactivity(log_), "idle", spark))
    assert idle == [195.0, 43000.0]


def _past_fences(rows):
    """Minutes, types and fences of long gaps by sorting all earlier gaps of a type again for each event."""
    out, last, seen = [], None, {}
    for kind, ts in sorted(rows, key=lambda r: r[1]):
        if last is not None:
            minutes, past = (ts - last).total_seconds() / 60, sorted(seen.get(kind, []))
            fence = None
            if past:
                q1, q3 = past[-(-len(past) // 4) - 1], past[-(-3 * len(past) // 4) - 1]
                fence = q3 + 1.5 * (q3 - q1)
            if (fence is not None and minutes > fence and fence > 20) or (kind == "log in" and minutes > 60) or minutes > 120:
                out.append((kind, minutes, fence))
            seen.setdefault(kind, []).append(minutes)
        last = ts
    return out


def test_stream_fence_goes_on_after_a_restart_and_forgets_the_silent(spark, tmp_path):
    rng, schema = random.Random(4), "student long, event_type string, event_date timestamp"
    times = [T0]
    while len(times) < 300:
        times.append(times[-1] + timedelta(minutes=rng.choice([1, 2, 5, 30, 31, 40, 90, 130])))
    rows = [(rng.choice(["edit recipe", "log in", None]), t) for t in times]

    def feed(part):
        spark.createDataFrame([(1, *r) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log_ = streaming.inactivity(streaming.read_log(spark, str(tmp_path / "in"), schema), delay="1 hour", lifetime="60 days")
        q = log_.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        q.processAllAvailable()
        q.stop()
        return [(r.event_type, r.minutes, r.maximum) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("event_date").collect()]

    feed(rows[:150])
    want = _past_fences(rows)
    assert feed(rows[150:]) == want and any(f is not None and f > 20 for _, _, f in want)
    end = times[-1]
    spark.createDataFrame([(2, "log in", end + timedelta(days=70))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed([])
    after = feed([("log in", end + timedelta(days=71)), ("log in", end + timedelta(days=71, minutes=5))])
    assert after == want  # the gap of 71 days belongs to no one: the student was forgotten


def test_fence_of_counts_equals_that_of_sorted_gaps():
    rng, gaps, counts, every = random.Random(5), [], [], []
    assert streaming._fence([], []) is None
    for _ in range(200):
        every.append(float(rng.randint(1, 12)))
        streaming._add(gaps, counts, every[-1])
        s, n = sorted(every), len(every)
        q1, q3 = s[-(-n // 4) - 1], s[-(-3 * n // 4) - 1]
        assert streaming._fence(gaps, counts) == q3 + 1.5 * (q3 - q1)
    assert gaps == sorted(set(every)) and sum(counts) == 200


def test_a_day_number_of_two_weeks_comes_once(spark):
    """In 2000 and 2001 the last and the first day share a number but no week; so do 1 August 1999 and 31 July 2000."""
    rows = [(1, "log in", "2000-12-31 10:00:00", 1, 0), (1, "log in", "2001-01-01 10:00:00", 1, 0), (1, "log in", "2001-01-02 10:00:00", 1, 0)]
    log = spark.createDataFrame(rows, "student int, event_type string, d string, calendar_year int, semester int")
    log = log.select("student", "event_type", F.col("d").cast("timestamp_ntz").alias("event_date"), "calendar_year", "semester")
    years = spark.createDataFrame([(1, 1, 1)], "student int, calendar_year int, school_year int")
    row = regularity.frequency_days(log, years).first()
    assert row.days_year == [153, 154] and row.number_of_weeks == 2

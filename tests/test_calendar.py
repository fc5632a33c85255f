"""Calendar columns against plain Python for every day of the school years 2013 to 2020."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tidewheel.operators import calendar as cal
from tidewheel.plans.config import CAPACITY, least_group

DAYS = [datetime(2013, 8, 1) + timedelta(days=i) for i in range((date(2021, 8, 1) - date(2013, 8, 1)).days)]


def expected(d):
    leap = d.year % 4 == 0
    doy, week = d.timetuple().tm_yday, d.isocalendar()[1]
    turn = 214 if leap else 213
    woy = week - 31 if week >= 31 else week + 21
    sem = 0 if doy >= turn or doy < 25 else 1
    moy = d.month - 8 if d.month >= 8 else d.month + 4
    day = doy - turn if doy >= turn else doy + 152
    early = sem == 1 and woy == 0
    return {"woy": woy, "biweek": woy // 2, "semester": 0 if early else sem, "moy": 0 if early and moy == 11 else moy, "doy": 0 if early and day > 350 else day}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(d, 1) for d in DAYS], "event_date timestamp_ntz, school_year int")
    out = cal.with_buckets(df).withColumns(
        {
            "flag": cal.log_semester(F.col("event_date")), "plain": cal.plain_day(F.col("event_date")), "dow": cal.sunday_weekday(F.col("event_date")),
            "dow2": cal.biweekly_weekday(F.col("event_date")), "label": cal.school_label(F.col("event_date"), 2013, 2020),
        }
    )
    return {r.event_date: r.asDict() for r in out.collect()}


def test_buckets_of_every_day(rows):
    for d in DAYS:
        got, want = rows[d], expected(d)
        assert {k: got[k] for k in want} == want, d
        assert got["semester_woy"] == want["woy"] - 25 * want["semester"]
        assert got["complete_moy"] == want["moy"] and got["complete_semester"] == want["semester"]
        assert got["dow"] == d.isoweekday() % 7 and got["dow2"] == d.isocalendar()[1] % 2 * 7 + d.isoweekday() % 7


def test_both_semesters_differ_on_a_few_days(rows):
    assert sum(r["flag"] != r["semester"] for r in rows.values()) == 26
    assert max(r["woy"] for r in rows.values()) < CAPACITY["woy"] and min(r[u] for r in rows.values() for u in ("woy", "doy", "moy", "semester_doy")) >= 0


def test_year_labels_at_the_boundary(spark):
    ts = ["2013-08-01 00:00:00", "2013-08-01 00:00:01", "2014-08-01 00:00:00", "2014-08-01 00:00:01", "2021-08-01 00:00:00", "2021-08-01 00:00:01", None]
    df = spark.createDataFrame([(t,) for t in ts], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = [r[0] for r in df.select(cal.school_label(F.col("t"), 2013, 2020)).collect()]
    assert got == [None, 1314, 1314, 1415, 2021, None, None]


def test_least_group():
    assert [least_group(139, 10), least_group(55, 5), least_group(10, 5)] == [14, 11, 2]

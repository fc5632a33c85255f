"""School-calendar columns of a timestamp. The school year begins on 1 August."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def school_start(ts: Column) -> Column:
    """Year in which the school year of ``ts`` began; midnight of 1 August still belongs to the year before."""
    return F.year(F.add_months(F.to_date(ts - F.expr("interval 1 microsecond")), -7))


def school_label(ts: Column, first: int | None = None, last: int | None = None) -> Column:
    """Both years' last two digits as one number (2013 -> 1314); null where the year began before ``first`` or after ``last``."""
    start = school_start(ts)
    label = (start % 100) * 100 + (start + 1) % 100
    if first is not None:
        label = F.when(start >= first, label)
    if last is not None:
        label = F.when(start <= last, label)
    return label


def log_semester(ts: Column) -> Column:
    """The event log's own semester flag, without regard to leap years."""
    day = F.dayofyear(ts)
    return F.when((day >= 214) | (day < 25), 0).otherwise(1)


def week_bucket(ts: Column) -> Column:
    week = F.weekofyear(ts)
    return F.when(week >= 31, week - 31).otherwise(week + 21)


def plain_day(ts: Column) -> Column:
    """Day of the school year as the regularity measures count it, without regard to leap years."""
    day = F.dayofyear(ts)
    return F.when(day >= 213, day - 213).otherwise(day + 152)


def sunday_weekday(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def biweekly_weekday(ts: Column) -> Column:
    """Day within two weeks, 0..13, by the parity of the ISO week."""
    return F.weekofyear(ts) % 2 * 7 + sunday_weekday(ts)


def with_buckets(df: DataFrame, ts: str = "event_date", school_year: str = "school_year") -> DataFrame:
    """Adds woy, biweek, moy, doy and semester, and the same counted from the semester's and the whole study's begin.

    In leap years the first day shifts by one. ISO week 31 can begin in July: those days move to the new year's
    semester 0, month 0 and day 0. ``complete_*`` need ``school_year``.
    """
    t, year = F.col(ts), F.year(ts)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    day, turn = F.dayofyear(t), F.when(leap, 214).otherwise(213)
    month = F.when(F.month(t) >= 8, F.month(t) - 8).otherwise(F.month(t) + 4)
    raw = df.withColumns(
        {
            "woy": week_bucket(t), "_moy": month, "_doy": F.when(day >= turn, day - turn).otherwise(day + 152),
            "_semester": F.when((day >= turn) | (day < 25), 0).otherwise(1),
        }
    )
    early = (F.col("_semester") == 1) & (F.col("woy") == 0)
    fixed = raw.withColumns(
        {
            "biweek": F.expr("woy div 2").cast("int"), "semester": F.when(early, 0).otherwise(F.col("_semester")),
            "moy": F.when(early & (F.col("_moy") == 11), 0).otherwise(F.col("_moy")),
            "doy": F.when(early & (F.col("_doy") > 350), 0).otherwise(F.col("_doy")),
        }
    ).drop("_moy", "_doy", "_semester")
    since = {"doy": (365, 177), "woy": (52, 25), "biweek": (26, 12), "moy": (12, 5)}
    years = F.col(school_year) - 1
    return fixed.withColumns(
        {f"complete_{u}": years * a + F.col(u) for u, (a, _) in since.items()}
        | {"complete_semester": years * 2 + F.col("semester")}
        | {f"semester_{u}": F.col(u) - F.col("semester") * b for u, (_, b) in since.items()}
    )


def semester_id(school_year: Column, semester: Column) -> Column:
    """1..6 over three school years."""
    return school_year * 2 + semester - 1

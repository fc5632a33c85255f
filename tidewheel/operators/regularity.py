"""Regularity of work: weekday, hour and day tables, and the measures over them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chi2_divergence, fourier_magnitude, js_similarity, set_overlap
from ..plans.config import QUIET
from ..sources import checkpointed
from .calendar import biweekly_weekday, plain_day, semester_id, sunday_weekday, week_bucket
from .events import session_ids

SEMESTER, YEARLY = ["calendar_year", "school_year", "semester"], ["calendar_year", "school_year"]


def _weekday(biweekly: bool) -> Column:
    ts = F.col("event_date")
    return biweekly_weekday(ts) if biweekly else sunday_weekday(ts)


def _with_years(events: DataFrame, years: DataFrame) -> DataFrame:
    return events.join(years.select("student", "calendar_year", "school_year"), ["student", "calendar_year"], "left")


def _with_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """Semester tables name the flag ``semester_aux`` and the running number ``semester``."""
    if "semester" not in keys:
        return df
    return df.withColumnRenamed("semester", "semester_aux").withColumn(
        "semester", semester_id(F.col("school_year"), F.col("semester_aux"))
    )


def _shares(distinct: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows of each ``by`` value in a group, absolute and relative to the group (null keys are a group that matches nothing)."""
    each = distinct.groupBy("student", *keys, by).agg(F.count("*").alias("absolute"))
    total = distinct.groupBy("student", *keys).agg(F.count("*").alias("total_events"))
    return each.join(total, ["student", *keys], "left").withColumn("relative", F.col("absolute") / F.col("total_events"))


def active_slots(events: DataFrame, years: DataFrame, keys: list[str] = SEMESTER) -> DataFrame:
    """The distinct (student, period, week, day, hour) of all events, with both weekdays; ``loud`` if one of them is no quiet event.

    All tables but the session hours follow from it.
    """
    ts = F.col("event_date")
    return _with_years(events, years).groupBy(
        "student", *dict.fromkeys(["calendar_year", *keys]), F.hour(ts).alias("hod"), plain_day(ts).alias("doy"), week_bucket(ts).alias("woy"),
        sunday_weekday(ts).alias("dow1"), biweekly_weekday(ts).alias("dow2"),
    ).agg(F.max(~F.col("event_type").isin(*QUIET)).alias("loud"))


def _weekdays(slots: DataFrame, biweekly: bool, keys: list[str]) -> DataFrame:
    raw = slots.filter("loud").select("student", *keys, F.col("dow2" if biweekly else "dow1").alias("dow"), "doy").distinct()
    return _with_id(_shares(raw, keys, "dow"), keys)


def _hours(slots: DataFrame, keys: list[str]) -> DataFrame:
    kept = [k for k in keys if k != "calendar_year"]
    raw = slots.filter("loud").select("student", "calendar_year", *kept, "hod", "doy").distinct()
    return _with_id(_shares(raw, kept, "hod").drop("total_events"), kept)


def weekday_table(events: DataFrame, years: DataFrame, *, biweekly: bool = False, keys: list[str] = SEMESTER) -> DataFrame:
    """Active days per weekday (or day of two weeks): ``absolute, relative, total_events``."""
    return _weekdays(active_slots(events, years, keys), biweekly, keys)


def hour_table(events: DataFrame, years: DataFrame, *, keys: list[str] = SEMESTER) -> DataFrame:
    """Active hours per hour of day: ``absolute, relative``; the groups do not tell calendar years apart."""
    return _hours(active_slots(events, years, keys), keys)


def hours_per_day(events: DataFrame, years: DataFrame, *, biweekly: bool = False, keys: list[str] = SEMESTER) -> DataFrame:
    """Per week (or two weeks) the session hours of each active weekday, in order of weekday, as arrays.

    With ``biweekly`` the weekday counts within two weeks while the rows stay weekly, as the published tables have it.
    """
    ts = F.col("event_date")
    raw = _with_years(session_ids(events), years).filter("event_type != 'be inactive'").withColumns(
        {"dow": _weekday(biweekly), "doy": plain_day(ts), "woy": week_bucket(ts)}
    )
    micros = F.unix_micros(F.col("event_date").cast("timestamp"))
    spans = raw.groupBy("student", *keys, "session", "woy", "doy", "dow").agg((F.max(micros) - F.min(micros)).alias("span"))
    days = spans.groupBy("student", *keys, "woy", "doy", "dow").agg((F.sum("span") / 3.6e9).alias("hours"))
    rows = F.array_sort(F.collect_list(F.struct("dow", "hours")))
    weeks = days.groupBy("student", *keys, "woy").agg(rows.alias("_d"))
    out = weeks.select(
        "student", *keys, "woy", F.transform("_d", lambda x: x["hours"]).alias("hours_dow"),
        F.transform("_d", lambda x: F.ceil(x["hours"])).alias("hours_dow_int"),
        F.transform("_d", lambda x: (x["hours"] > 0).cast("int")).alias("hours_bool"), F.transform("_d", lambda x: x["dow"]).alias("dow"),
    )
    return _with_id(out, keys)


def frequency_hours(events: DataFrame, years: DataFrame, *, keys: list[str] = SEMESTER) -> DataFrame:
    """Active hours counted from the school year's begin, by hour of day then day, and the number of active weeks."""
    raw = active_slots(events, years, keys)
    out = raw.groupBy("student", *keys).agg(
        F.count_distinct("woy").alias("number_of_weeks"),
        F.transform(F.array_sort(F.collect_list(F.struct("hod", "doy"))), lambda x: x["hod"] + x["doy"] * 24).alias("hours_day"),
    )
    return _with_id(out, keys)


def frequency_days(events: DataFrame, years: DataFrame, *, keys: list[str] = SEMESTER) -> DataFrame:
    """Active days of the school year in order, once each, and the number of active weeks.

    The days of two years that share a number can lie in different weeks, so a number can come with more than one."""
    ts = F.col("event_date")
    raw = _with_years(events, years).select("student", *keys, plain_day(ts).alias("doy"), week_bucket(ts).alias("woy")).distinct()
    out = raw.groupBy("student", *keys).agg(
        F.count_distinct("woy").alias("number_of_weeks"), F.array_sort(F.collect_set("doy")).alias("days_year")
    )
    return _with_id(out, keys)


def peak(table: DataFrame, keys: list[str], slots: int, name: str) -> DataFrame:
    """(log2(slots) - entropy of ``relative`` in nats) * the largest ``absolute``; null if all shares are null."""
    p = F.col("relative")
    entropy = -F.sum(F.when(p > 0, p * F.log(p)).when(p == 0, F.lit(0.0)))
    return table.groupBy("student", *keys).agg(((F.lit(math.log2(slots)) - entropy) * F.max("absolute")).alias(name))


def densified(table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """A row for every group and every value of ``by`` in the table, 0 where a group has none.

    The values are a bounded set (weekdays or hours), so each group carries them as an array.
    """
    domain = table.agg(F.array_sort(F.collect_set(by)).alias("_all"))
    groups = table.select("student", *keys).distinct().crossJoin(F.broadcast(domain)).withColumn(by, F.explode("_all")).drop("_all")
    return groups.join(table.select("student", *keys, by, "absolute", "relative"), ["student", *keys, by], "left").na.fill(0, ["absolute", "relative"])


def _week_vectors(weeks: DataFrame, keys: list[str], values: str, slots: int) -> DataFrame:
    """Per student and period an array of (week, dense vector); a student has at most some dozen weeks a period."""
    pairs = F.arrays_zip(F.col("dow").alias("d"), F.transform(values, lambda x: x.cast("double")).alias("x"))

    def at(i: Column) -> Column:  # two days of one weekday share a week bucket at a year's turn: the last one stands
        return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["d"] == i), F.lit(-1))["x"], F.lit(0.0))

    vector = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), at)
    return weeks.groupBy("student", *keys).agg(
        F.array_sort(F.collect_list(F.struct("woy", vector.alias("v")))).alias("w")
    )


def _pairs(value) -> Column:
    """``value(a, b)`` of each pair of the array ``w``, once each, flattened."""
    n = F.size("w")
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.when(i < n, F.transform(F.slice("w", i + 1, n), lambda b: value(F.element_at("w", i), b))).otherwise(
                F.array().cast("array<double>")
            ),
        )
    )


def week_similarity(weeks: DataFrame, keys: list[str], slots: int = 14) -> DataFrame:
    """``ws1, ws2, ws3`` over all pairs of a student's weeks: overlap of active days, Jensen-Shannon similarity and
    chi-square similarity of the hours; null where no pair counts. A day is active if it has session time."""
    rows = _week_vectors(weeks, keys, "hours_dow", slots)
    one = _pairs(lambda a, b: set_overlap(a["v"], b["v"]))
    two = _pairs(lambda a, b: js_similarity(a["v"], b["v"]))
    three = _pairs(lambda a, b: chi2_divergence(a["v"], b["v"]))

    def mean(pairs: Column) -> Column:
        seen = F.filter(pairs, lambda x: x.isNotNull())
        return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen))

    return rows.select("student", *keys, mean(one).alias("ws1"), mean(two).alias("ws2"), mean(three).alias("ws3"))


def fourier(table: DataFrame, keys: list[str], column: str, frequency: float, name: str) -> DataFrame:
    """|sum of cos(2 pi f n)| over the distinct values of an array column; 0 for an empty or null array."""
    return table.select("student", *keys, fourier_magnitude(F.col(column), frequency).alias(name))


def regularity(events: DataFrame, years: DataFrame, *, semesters: bool = True) -> DataFrame:
    """All measures per student and period, keyed by the running semester number or the school year.

    ``pwd`` of semesters is the 14-day version, as the published table has it.
    """
    keys = SEMESTER if semesters else YEARLY
    out_keys = [*keys[:2], "semester_aux", "semester"] if semesters else keys
    slots = checkpointed(active_slots(events, years, keys))  # read by five tables, the log once
    dow2, hod = checkpointed(_weekdays(slots, True, keys)), _hours(slots, keys)
    weeks2 = hours_per_day(events, years, biweekly=True, keys=keys)
    hours = slots.groupBy("student", *keys).agg(F.collect_set(F.col("hod") + F.col("doy") * 24).alias("h"), F.collect_set("doy").alias("d"))
    waves = _with_id(hours, keys).select(
        "student", *out_keys, fourier_magnitude(F.col("h"), 1 / 24).alias("fdh"), fourier_magnitude(F.col("h"), 7 / 24).alias("fwh"),
        fourier_magnitude(F.col("h"), 14 / 24).alias("fwh_biweek"), fourier_magnitude(F.col("d"), 1 / 7).alias("fwd"),
    )
    hod_keys = [k for k in out_keys if k != "calendar_year"]
    two = peak(dow2, out_keys, 14, "pwd_biweek")
    if semesters:
        out = two.withColumn("pwd", F.col("pwd_biweek"))
    else:
        out = peak(_weekdays(slots, False, keys), out_keys, 7, "pwd").join(two, ["student", *out_keys], "left")
    out = out.join(waves, ["student", *out_keys], "left").join(week_similarity(weeks2, out_keys), ["student", *out_keys], "left")
    return out.join(peak(hod, hod_keys, 24, "phd"), ["student", *hod_keys], "left")

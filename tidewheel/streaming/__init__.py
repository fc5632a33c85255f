"""The log as a stream: bucket counts with a watermark, sessions with a fixed gap, and inactivity with a learnt fence."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.config import WRITE, WRITE_R

_IDLE = "student long, event_type string, event_date timestamp, minutes double, maximum double"


def read_log(spark, path: str, schema) -> DataFrame:
    """An append-only folder of event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def bucket_counts(events: DataFrame, *, delay: str = "1 day", width: str = "7 days") -> DataFrame:
    """Events and writing events per student and time window; rows later than ``delay`` are left out."""
    kind = F.col("event_type")
    return (
        events.withWatermark("event_date", delay).groupBy("student", F.window("event_date", width))
        .agg(
            F.count("*").alias("total_events"), F.count_if(kind.isin(*WRITE)).alias("writing_events"),
            F.count_if(kind.isin(*WRITE_R)).alias("writing_events_with_reflection"),
        )
        .select("student", F.col("window.start").alias("begin"), "total_events", "writing_events", "writing_events_with_reflection")
    )


def sessions(events: DataFrame, *, gap: str = "60 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of a student that a fixed gap ends: begin, minutes to the last event, events."""
    return (
        events.withWatermark("event_date", delay).groupBy("student", F.session_window("event_date", gap))
        .agg(F.count("*").alias("session_events"), F.min("event_date").alias("begin"), F.max("event_date").alias("_last"))
        .select("student", "begin", ((F.unix_micros("_last") - F.unix_micros("begin")) / 60e6).alias("session_duration"), "session_events")
    )


_STATE = "last timestamp, kinds array<string>, gaps array<array<double>>, counts array<array<long>>"


def _fence(gaps: list[float], counts: list[int]) -> float | None:
    """Third quartile plus 1.5 interquartile ranges, with discrete percentiles, of sorted values and how often each occurs."""
    n = sum(counts)
    if not n:
        return None
    found, at, wanted = [], 0, [-(-n // 4), -(-3 * n // 4)]
    for gap, count in zip(gaps, counts, strict=True):
        at += count
        while len(found) < 2 and at >= wanted[len(found)]:
            found.append(gap)
    q1, q3 = found
    return q3 + 1.5 * (q3 - q1)


def _add(gaps: list[float], counts: list[int], gap: float) -> None:
    at = bisect_left(gaps, gap)
    if at < len(gaps) and gaps[at] == gap:
        counts[at] += 1
    else:
        gaps.insert(at, gap), counts.insert(at, 1)


def _idle(lifetime: pd.Timedelta):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, *rest = state.get if state.exists else (None, [], [], [])
        seen = {k: (list(g), list(n)) for k, g, n in zip(*rest, strict=True)}
        out = []
        rows = pd.concat(list(frames), ignore_index=True).dropna(subset=["event_date"]).sort_values("event_date", kind="stable")
        for kind, ts in zip(rows["event_type"], rows["event_date"], strict=True):
            if last is not None and ts >= last:  # a late event comes too late to end a gap
                minutes = (ts - last).total_seconds() / 60
                past = seen.setdefault(kind, ([], []))
                fence = _fence(*past)
                if (fence is not None and minutes > fence and fence > 20) or (kind == "log in" and minutes > 60) or minutes > 120:
                    out.append((key[0], kind, last + pd.Timedelta(seconds=3), minutes, fence))
                _add(*past, minutes)
            last = ts if last is None or ts > last else last
        if last is not None:
            state.update((last, list(seen), [g for g, _ in seen.values()], [n for _, n in seen.values()]))
            ends = int((last + lifetime).value // 1_000_000)
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["student", "event_type", "event_date", "minutes", "maximum"])

    return run


def inactivity(events: DataFrame, *, delay: str = "1 day", lifetime: str = "730 days") -> DataFrame:
    """Inactivity rows as events arrive: a gap is judged by the fence of the student's earlier gaps of that type.

    Unlike in the batch the fence knows the past alone. A student's state holds each type's gaps as sorted values with counts, so it
    grows with the different gaps (of logs in whole minutes at most with the minutes of ``lifetime``), not with the events. Events
    later than ``delay`` are left out, null times too; a student silent for ``lifetime`` is forgotten and starts anew.
    """
    rows = events.select("student", "event_type", "event_date").withWatermark("event_date", delay)
    return rows.groupBy("student").applyInPandasWithState(
        _idle(pd.Timedelta(lifetime)), _IDLE, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )

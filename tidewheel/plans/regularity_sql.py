"""DuckDB SQL of all regularity measures per period, over the tables ``olog`` and ``years``."""

from __future__ import annotations

from .config import QUIET

_DOY = "case when dayofyear(event_date) >= 213 then dayofyear(event_date) - 213 else dayofyear(event_date) + 152 end"
_WOY = "case when weekofyear(event_date) >= 31 then weekofyear(event_date) - 31 else weekofyear(event_date) + 21 end"


def _peak(table: str, keys: str, slots: int, name: str) -> str:
    return f"select {keys}, (log2({slots}) + sum(relative * ln(relative))) * max(absolute) as {name} from {table} group by {keys}"


def _shares(source: str, keys: str, by: str) -> str:
    return f"""select * from (select {keys}, {by}, count(*) as absolute from {source} group by all) left join
        (select {keys}, count(*) as whole from {source} group by all) using ({keys})"""


def complete(keys: str) -> str:
    """One row per ``keys`` (student, calendar year, school year, and the semester or not); a semester's name is its running number."""
    half = "semester" in keys
    hour_keys = keys.replace("calendar_year, ", "")
    quiet = ", ".join(f"'{q}'" for q in QUIET)
    week = ", ".join(f"p.{k}" for k in keys.split(", "))
    same = " and ".join(f"{{0}}.{k} is not distinct from p.{k}" for k in keys.split(", "))
    shown = keys.replace(", semester", ", semester as semester_aux, school_year * 2 + semester - 1 as semester")
    fourier = ", ".join(
        f"abs(sum(cos(2 * pi() * {f} * x))) as {n}" for n, f in (("fdh", "(1.0 / 24)"), ("fwh", "(7.0 / 24)"), ("fwh_biweek", "(14.0 / 24)"))
    )
    return f"""with reg as (select *, {_DOY} as doy, {_WOY} as woy, hour(event_date) as hod, dayofweek(event_date) as d1,
        weekofyear(event_date) % 2 * 7 + dayofweek(event_date) as d2 from olog left join years using (student, calendar_year)),
    r1 as (select distinct {keys}, d1, doy from reg where event_type not in ({quiet})),
    r2 as (select distinct {keys}, d2, doy from reg where event_type not in ({quiet})),
    rh as (select distinct {keys}, hod, doy from reg where event_type not in ({quiet})),
    t1 as (select *, absolute / whole as relative from ({_shares("r1", keys, "d1")})),
    t2 as (select *, absolute / whole as relative from ({_shares("r2", keys, "d2")})),
    th as (select *, absolute / whole as relative from ({_shares("rh", hour_keys, "hod")})),
    p1 as ({_peak("t2" if half else "t1", keys, 14 if half else 7, "pwd")}),
    p2 as ({_peak("t2", keys, 14, "pwd_biweek")}),
    ph as ({_peak("th", hour_keys, 24, "phd")}),
    f1 as (select {keys}, {fourier} from (select distinct {keys}, hod + doy * 24 as x from reg) group by all),
    f2 as (select {keys}, abs(sum(cos(2 * pi() * (1.0 / 7) * x))) as fwd from (select distinct {keys}, doy as x from reg) group by all),
    span as (select {keys}, woy, doy, d2, (epoch_us(max(event_date)) - epoch_us(min(event_date))) / 3.6e9 as hours from reg group by all),
    slot as (select {keys}, woy, d2, max(hours) as hours from span group by all),
    tot as (select {keys}, woy, sum(hours) as s, sum((hours > 0)::int) as n from slot group by all),
    pair as (select {week}, p.woy as wa, q.woy as wb, p.s as ta, q.s as tb, p.n as na, q.n as nb from tot p join tot q on {same.format("q")} and p.woy < q.woy),
    duo as (select {week}, wa, wb, ta, tb, na, nb, coalesce(x.hours, 0) as x, coalesce(y.hours, 0) as y from pair p cross join (select unnest(range(14)) as i) i
        left join slot x on {same.format("x")} and x.woy = wa and x.d2 = i.i left join slot y on {same.format("y")} and y.woy = wb and y.d2 = i.i),
    sim as (select {keys}, case when na > 0 and nb > 0 then sum((x > 0 and y > 0)::int) / greatest(na, nb) else 0 end as s1,
        case when ta > 0 and tb > 0 then 1 - sqrt(greatest(sum(case when x > 0 then x / ta * log2(x / ta / ((x / ta + y / tb) / 2)) else 0 end
        + case when y > 0 then y / tb * log2(y / tb / ((x / ta + y / tb) / 2)) else 0 end) / 2, 0)) end as s2,
        case when ta > 0 and tb > 0 then 1 - sum(case when x + y > 0 then pow((x / ta - y / tb) / (x / ta + y / tb), 2) else 0 end) / sum((x > 0 or y > 0)::int) end as s3
        from duo group by {keys}, wa, wb, na, nb, ta, tb),
    ws as (select {keys}, avg(s1) as ws1, avg(s2) as ws2, avg(s3) as ws3 from sim group by all)
    select {shown}, {", ".join(f"round({c}, 6) as {c}" for c in MEASURES)} from p1 left join p2 using ({keys}) left join ws using ({keys})
    left join f1 using ({keys}) left join f2 using ({keys}) left join ph using ({hour_keys})"""


MEASURES = ("pwd", "pwd_biweek", "ws1", "ws2", "ws3", "fdh", "fwh", "fwh_biweek", "fwd", "phd")

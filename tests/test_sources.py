"""Tables that survive failed jobs, layouts without shuffles, and another database over JDBC."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tidewheel import sources
from tidewheel.operators import events


def broken(df):
    """``df`` with a row that fails while it is written."""
    return df.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))


def test_a_failed_refresh_keeps_the_old_rows(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k int, v string").repartition(5)
    sources.refresh(df.filter("k < 2"), root, "t")
    with pytest.raises(PySparkException):
        sources.refresh(broken(df), root, "t")
    assert {r.k for r in sources.stored_table(spark, root, "t").collect()} == {0, 1}
    reading = sources.stored_table(spark, root, "t")
    again = sources.refresh(sources.stored_table(spark, root, "t").unionByName(df.filter("k = 4")), root, "t")  # reads itself
    assert {r.k for r in again.collect()} == {0, 1, 4} and reading.count() == 2
    sources.append(df.filter("k = 2"), root, "t")
    assert sources.stored_table(spark, root, "t").count() == 4
    for n in (1, 2, 3):
        sources.refresh(df.limit(n), root, "t")
    assert len(list((tmp_path / "t.versions").iterdir())) == 2


def test_single_years_are_replaced(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(y, k, f"{y}.{k}") for y in (9596, 9697, 9798) for k in range(4)], "calendar_year int, k int, v string")
    sources.refresh(df, root, "log", partition_by=("calendar_year",))
    new = df.filter("calendar_year = 9697 and k < 2").withColumn("v", F.lit("new"))
    sources.replace_partitions(new, root, "log", "calendar_year")
    rows = {(r.calendar_year, r.k): r.v for r in sources.stored_table(spark, root, "log").collect()}
    assert len(rows) == 10 and rows[9697, 1] == "new" and rows[9596, 1] == "9596.1"
    with pytest.raises(PySparkException):
        sources.replace_partitions(broken(df.filter("calendar_year = 9798").repartition(4)), root, "log", "calendar_year")
    assert {(r.calendar_year, r.k): r.v for r in sources.stored_table(spark, root, "log").collect()} == rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_log_needs_no_exchange(spark):
    rng, start = random.Random(2), dt.datetime(1997, 9, 1)
    kinds = ["log in", "edit recipe", "write new recipe"]
    rows = [(s, rng.choice(kinds), start + dt.timedelta(minutes=rng.randint(0, 90_000)), n, 9798 + 101 * (n % 2)) for n, s in enumerate(rng.choices(range(40), k=600))]
    log = spark.createDataFrame(rows, "student long, event_type string, event_date timestamp_ntz, number long, calendar_year int")
    grades = spark.createDataFrame([(s, 9798, 2) for s in range(10)], "student long, calendar_year int, school_year int")
    name = f"log_{uuid.uuid4().hex[:8]}"
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        made = sources.save_bucketed(log, name, "student", sort=("event_date", "number"), buckets=4)
        marks = sources.save_bucketed(grades, f"{name}_g", "student", buckets=4)
        steps = {
            "gaps": lambda df, g: events.inter_event_gaps(df, tie="number"), "sessions": lambda df, g: events.session_ids(df),
            "years": lambda df, g: events.school_years(df, g.hint("merge"), ("edit recipe",)),
        }
        for step in steps.values():
            found, want = step(made, marks), step(log, grades)
            assert "Exchange" not in plan(found) and "Exchange" in plan(want)
            assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    finally:
        spark.sql(f"drop table if exists {name}"), spark.sql(f"drop table if exists {name}_g")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


@pytest.fixture(scope="module")
def derby(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"
    sources.execute(spark, url, "create table people (id bigint, name varchar(40), x double)")
    rows = [(7 if i % 3 else i, f"n{i % 50}'s", float("nan") if i == 5 else i / 2) for i in range(900)]
    sources.jdbc_insert(spark.createDataFrame(rows, "id long, name string, x double"), url, "people")
    sources.execute(spark, url, "insert into people values " + ", ".join(["(null, null, null)"] * 4))
    return url, rows + [(None, None, None)] * 4


@pytest.mark.parametrize("column", ["ID", "NAME"])
def test_split_reads_have_every_row_once(spark, derby, column):
    url, rows = derby
    some = sources.jdbc(spark, url, "select * from people", split=(column, 4))
    assert 4 <= some.rdd.getNumPartitions() <= 6
    key = lambda r: str(tuple(r))
    want = [(i, n, None if x is None or x != x else x) for i, n, x in rows]
    assert sorted(map(key, some.collect())) == sorted(map(key, want))


def test_filters_and_columns_go_into_the_statement(spark, derby):
    url, rows = derby
    some = sources.jdbc(spark, url, "select * from people").filter("ID = 7 and X > 100").select("NAME")
    text = plan(some)
    assert "PushedFilters: [*IsNotNull(ID), *IsNotNull(X), *EqualTo(ID,7), *GreaterThan(X,100.0)]" in text and "ReadSchema: struct<NAME:string>" in text
    assert some.count() == sum(i == 7 and x is not None and x > 100 for i, _, x in rows)


def test_statements_and_inserts(spark, derby):
    url, rows = derby
    assert sources.execute(spark, url, "update people set x = 1 where id = 9") == 1
    sources.jdbc_insert(spark.createDataFrame([(-1, "new", float("nan"))], "id long, name string, x double"), url, "people")
    assert sources.jdbc(spark, url, "select x from people where id = -1").first()[0] is None
    assert sources.execute(spark, url, "delete from people where id = -1") == 1
    with pytest.raises(Exception, match="NOWHERE"):
        sources.execute(spark, url, "delete from nowhere")


def test_insert_by_position(spark):
    name = f"rows_{uuid.uuid4().hex[:8]}"
    spark.sql(f"create table {name} (a int, b double) using parquet")
    try:
        sources.insert(spark.createDataFrame([(1, float("nan")), (2, 2.5)], "x int, y double"), name)
        assert {tuple(r) for r in spark.table(name).collect()} == {(1, None), (2, 2.5)}
    finally:
        spark.sql(f"drop table {name}")

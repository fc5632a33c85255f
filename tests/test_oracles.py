"""Every query with an oracle against DuckDB on the smallest tables, and the driver's contract."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from tidewheel.plans import cantons, catalogue, config, study

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(float(v) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(df):
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_oracles_are_those_of_clustering(spark):
    """SQL has no eigenvectors; ``test_study`` holds these against plain numpy."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {
        "spectral_labels", "cluster_scores", "cluster_sweep", "evolutionary_labels", "affect_alpha", "kmodes_profiles", "kmodes_single_run",
        "feature_search", "study_profiles", "study_adaptive_profiles",
    }


def test_searches_run_over_the_whole_grids(spark):
    scores = catalogue.QUERIES["cluster_scores"](spark, SF).toPandas()
    cells = set(map(tuple, scores[["window_size", "gamma", "clusters"]].drop_duplicates().to_numpy().tolist()))
    assert cells == {(w, g, k) for w in config.WINDOWS["dtw"] for g in config.GAMMAS for k in config.CLUSTERS}
    assert set(catalogue.QUERIES["kmodes_profiles"](spark, SF).toPandas()["clusters"]) == set(config.PROFILE_CLUSTERS)
    assert set(catalogue.QUERIES["evolutionary_labels"](spark, SF).toPandas()["t"]) == {1, 2, 3, 4, 5, 6}


def test_study_takes_every_feature_window_and_semester(spark):
    found = cantons.distances(spark, SF).cache()
    for canton, (_, groups) in cantons.CANTONS.items():
        mine = found.filter(f"g div 10 = {canton}")
        windows = {(r.feature, r.window_size) for r in mine.select("feature", "window_size").distinct().collect()}
        varied = {f for f, _ in windows}  # a feature that is the same for all of a cohort has no scaled distances
        assert windows == {(f, w) for g in groups.values() for f in g["features"] if f in varied for w in config.WINDOWS[g["metric"]]}
        assert {"total_duration", "writing_events", "writing_events_norm"} <= varied
        assert {r.t for r in mine.selectExpr("g % 10 as t").distinct().collect()} <= {1, 2, 3, 4, 5, 6}


@pytest.mark.parametrize("name", ["feature_search", "study_profiles", "study_adaptive_profiles"])
def test_the_study_runs_for_both_cantons(spark, monkeypatch, name):
    """Whole features and semesters over a part of the grid; the whole grid is the query's."""
    monkeypatch.setattr(study, "GAMMAS", [0.5, 1.5]), monkeypatch.setattr(study, "WINDOWS", {"dtw": [0, 3], "euclidean": [1]})
    rows = catalogue.QUERIES[name](spark, SF).collect()
    assert {r.canton for r in rows} == {1, 2} and len({r.t for r in rows}) > 3
    if name == "study_adaptive_profiles":
        assert {r.clusters for r in rows} == set(config.PROFILE_CLUSTERS)


def test_driver_contract(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_the_active_cohort_is_all_outside_the_first_canton(spark, duck):
    """Every nation whose number 3 does not divide; the cohort queries leave none of them out."""
    found = catalogue.QUERIES["cohort_active"](spark, SF).select("student").distinct().toPandas()["student"].tolist()
    nations = duck.execute(f"select distinct c_nationkey from customer where c_custkey in ({','.join(map(str, found))})").fetchdf()["c_nationkey"]
    assert {n % 3 for n in nations} == {1, 2} and len(nations) > 10


def test_what_several_parts_read_is_stored(spark):
    """The series to be drawn and a matrix's school years are made once: no part goes back to the log for them."""
    shown = catalogue.QUERIES["plot_ready_series"](spark, SF)
    assert not [f for f in shown.inputFiles() if "orders" in f]
    matrix = catalogue.QUERIES["yearly_matrix"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "_graded" not in matrix

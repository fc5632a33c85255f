"""Experiment tables: typed logs of searches and labels, and the choice of the best parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cohort import latest_per_key

_COMMON = "experiment string, experiment_date timestamp, canton string, time_unit string, period string, features array<string>"
#: Explicit key columns take the place of names that would have to be parsed.
SCHEMAS = {
    "gridsearch": f"{_COMMON}, model string, metric string, school_year int, gamma double, window_size int, clusters int, "
    "s_distortion double, s_bic double, s_sil_km double, s_eigen array<double>",
    "gridsearch_fg": f"{_COMMON}, model string, metric string, school_year int, gammas array<double>, windows array<int>, clusters int, "
    "s_distortion double, s_bic double, s_sil_km double, s_eigen array<double>",
    "gridsearch_kmodes": f"{_COMMON}, adaptive boolean, school_year int, clusters int, students_group array<int>, "
    "students_group_min int, s_sil_km double",
    "labels_metadata": f"{_COMMON}, exp_id timestamp, model string, metric string, clusters int, gamma double, window_size int, alphas array<double>",
    "group_labels_metadata": f"{_COMMON}, exp_id timestamp, metric string, clusters int, gammas array<double>, windows array<int>, feature_group string",
    "labels": "experiment string, student long, calendar_year int, label int",
}


# What stands for an experiment without a search, and for one without labels.
UNTRIED = {"gamma": 1.0, "window_size": 1, "clusters": 2, "model": "spectral"}
UNLABELLED = {"gamma": 1.0, "window_size": 2, "clusters": 3}


def log_rows(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """Rows of one of the tables; columns left out are null, unknown ones are an error."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SCHEMAS[table])
    for r in rows:
        if unknown := set(r) - set(schema.names):
            raise ValueError(f"{table} has no columns {sorted(unknown)}")
    return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)


def append(rows: DataFrame, root: str, table: str) -> None:
    rows.write.mode("append").parquet(f"{root}/{table}")


def optimal_params(log: DataFrame, keys: tuple[str, ...] = ("experiment",), cell: tuple[str, ...] = ("clusters", "window_size", "gamma"),
                   score: str = "s_sil_km", default: dict | None = None, experiments: DataFrame | None = None) -> DataFrame:
    """Of the latest run of each cell the one with the best score, per experiment. Null and NaN scores never win.

    Among equal scores the fewest clusters, then the smallest window and gamma win. An experiment of ``experiments(keys)`` without a
    usable run has the values of ``default`` (null for columns it leaves out).
    """
    latest = latest_per_key(log, [*keys, *cell], "experiment_date").filter(F.col(score).isNotNull() & ~F.isnan(score))
    rest = [c for c in latest.columns if c not in keys]
    best = latest.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(score), *[-F.col(c) for c in cell])).alias("_b")
    )
    found = best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])
    return found if experiments is None else with_default(found, experiments, keys, default or UNTRIED)


def with_default(found: DataFrame, experiments: DataFrame, keys: tuple[str, ...], default: dict) -> DataFrame:
    """``found`` and, for each of ``experiments(keys)`` that it lacks, a row of ``default`` values."""
    kinds = {c: found.schema[c].dataType for c in found.columns}
    lacking = experiments.select(*keys).distinct().join(found, list(keys), "left_anti")
    rows = lacking.select(*(F.col(c) if c in keys else F.lit(default.get(c)).cast(kinds[c]).alias(c) for c in found.columns))
    return found.unionByName(rows)


def latest_metadata(log: DataFrame, experiments: DataFrame, keys: tuple[str, ...] = ("experiment",), default: dict | None = None) -> DataFrame:
    """The latest metadata row of each experiment; one that was never run has ``default``."""
    return with_default(latest_per_key(log, list(keys), "experiment_date"), experiments, keys, default or UNLABELLED)


def contingency(labels: DataFrame, a: Column, b: Column) -> DataFrame:
    """Students by pair of labels."""
    return labels.groupBy(a.alias("label_a"), b.alias("label_b")).agg(F.count("*").alias("n"))

"""Other databases over JDBC: parallel reads by the key's own quantiles, inserts and statements."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative error of the quantiles that a read is split at.
ERROR = 0.001


def _reader(spark: SparkSession, url: str, properties: dict[str, str]):
    return spark.read.format("jdbc").option("url", url).options(**properties)


def key_splits(spark: SparkSession, url: str, query: str, column: str, parts: int, **properties: str) -> list[str]:
    """Predicates that part the rows of a query by a numeric or text column: every row meets exactly one.

    The bounds are quantiles of the column itself, read alone, so parts are even however its values lie; a value so frequent that it is several
    quantiles is one bound. Nulls are a part of their own.
    """
    key = _reader(spark, url, properties).option("query", f"select {column} as k from ({query}) q").load().toDF("k")
    if dict(key.dtypes)["k"] == "string":
        # Text has no approximate quantiles: every n-th of the distinct values in order, of which at most 100 000 are looked at.
        ranked = [r["k"] for r in key.filter("k is not null").groupBy("k").count().orderBy(F.xxhash64("k")).limit(100_000).select("k").sort("k").collect()]
        bounds = ranked[len(ranked) // parts :: max(1, len(ranked) // parts)][: parts - 1]
        literal = ["'" + text.replace("'", "''") + "'" for text in bounds]
    else:
        found = key.filter("k is not null").agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], F.lit(int(1 / ERROR))).alias("b")).first()["b"] if parts > 1 else []
        literal = [str(x) for x in dict.fromkeys(found or [])]
    if not literal:
        return [f"{column} is null", f"{column} is not null"]
    middle = [f"{column} >= {a} and {column} < {b}" for a, b in zip(literal, literal[1:], strict=False)]
    return [f"{column} is null", f"{column} < {literal[0]}", *middle, f"{column} >= {literal[-1]}"]


def jdbc(spark: SparkSession, url: str, query: str, *, split: tuple[str, int] | None = None, **properties: str) -> DataFrame:
    """A query of another database; ``split`` (column, parts) reads it in parallel, a connection a part.

    Filters and columns that are asked of the result go into the database's own statement.
    """
    if split is None:
        return _reader(spark, url, properties).option("dbtable", f"({query}) q").load()
    predicates = key_splits(spark, url, query, *split, **properties)
    return spark.read.jdbc(url, f"({query}) q", predicates=predicates, properties=properties)


def jdbc_insert(df: DataFrame, url: str, table: str, *, batch: int = 10_000, **properties: str) -> None:
    """Add rows by column name to a table of another database, NaN as null."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    plain = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df
    plain.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**properties).mode("append").save()


def execute(spark: SparkSession, url: str, statement: str) -> int:
    """Run a statement that gives no rows in another database, from the driver; the rows it touched. Errors are raised."""
    with contextlib.closing(spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)) as connection, contextlib.closing(connection.createStatement()) as s:
        return s.executeUpdate(statement)

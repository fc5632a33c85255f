"""The place of each row in an order over a whole table, without bringing the table into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import checkpointed


def positions(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """``df`` with its rows' places from 0 on in ``order``, which should leave no ties: tied rows get places in any order and share a range.

    Rows are cut into ranges of the order; a range's first place is the sum of the sizes before it, of which the driver holds one number
    a range. Columns of the name ``_range`` or ``_before`` may not be in ``df``.
    """
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, at = [], 0
    for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        before.append((r["_range"], at))
        at += r.n
    starts = df.sparkSession.createDataFrame(before, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_row", within).join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_row")).drop(
        "_range", "_before", "_row"
    )

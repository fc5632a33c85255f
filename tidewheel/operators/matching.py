"""Renaming of clusters after an earlier labelling: an assignment problem on the contingency table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import checkpointed


def contingency_of(rows: DataFrame, group: list[str]) -> DataFrame:
    """``contingency`` of ``rows(group..., label, previous)`` that hold both labels of a member: an aggregate, no join of the members."""
    return rows.groupBy(*group, "label", "previous").agg(F.count("*").alias("n"))


def contingency(labels: DataFrame, previous: DataFrame, group: list[str]) -> DataFrame:
    """``group..., label, previous, n``: members of a group by their label now and before; ``labels`` and ``previous`` are ``group..., member, label``."""
    past = previous.select(*group, "member", F.col("label").alias("previous"))
    return contingency_of(labels.join(past, [*group, "member"]), group)


def gains(table: DataFrame, group: list[str]) -> DataFrame:
    """``group..., label, name, gain``: what the weighted F1 against the labels before gains when a cluster takes a name, for each of the group's names.

    A cluster of s members, h of which had the name before, gains s * 2 h / (s + the name's members before) over all members.
    Gains are decimals, so that sums of the same gains are equal in any order.
    """
    sizes = table.groupBy(*group, "label").agg(F.sum("n").alias("s"))
    named = table.groupBy(*group, F.col("previous").alias("name")).agg(F.sum("n").alias("before"))
    whole = sizes.groupBy(*group).agg(F.sum("s").alias("members"), F.collect_set("label").alias("names"))
    every = sizes.join(whole, group).withColumn("name", F.explode("names")).drop("names")
    hits = table.select(*group, "label", F.col("previous").alias("name"), "n")
    rows = every.join(hits, [*group, "label", "name"], "left").join(named, [*group, "name"], "left")
    share = F.col("s") * 2.0 * F.coalesce("n", F.lit(0)) / (F.col("s") + F.coalesce("before", F.lit(0))) / F.col("members")
    return rows.select(*group, "label", "name", share.cast("decimal(20,15)").alias("gain"))


def best_names(table: DataFrame, group: list[str], clusters: int) -> DataFrame:
    """``group..., label, name, f1``: the renaming of each group's labels among themselves with the largest weighted F1.

    Of equal renamings the one with the smallest names in order of the labels is taken. Labels are named one after the other; of all ways
    to give out the same names only the best goes on, so at most 2 ** ``clusters`` rows a group are there at a time, where trying every
    permutation would take their factorial. ``clusters`` is the largest number of labels in a group (30 at most).
    """
    rows = checkpointed(gains(checkpointed(table), group))  # a few rows a group, read by every turn
    turns = Window.partitionBy(*group).orderBy("label")
    numbered = rows.select(*group, "label").distinct().withColumn("turn", F.row_number().over(turns))
    places = rows.select(*group, F.col("label").alias("name")).distinct().withColumn("bit", F.row_number().over(Window.partitionBy(*group).orderBy("name")) - 1)
    steps = rows.join(numbered, [*group, "label"]).join(places, [*group, "name"])
    count = numbered.groupBy(*group).agg(F.max("turn").alias("turns"))
    none = F.array().cast("array<struct<bit:int,name:bigint,label:bigint>>")
    first = count.select(*group, "turns", F.lit(0).alias("given"), none.alias("path"), F.lit(0).cast("decimal(25,15)").alias("f1"))
    step = F.struct(*(F.col(c).cast(kind).alias(c) for c, kind in (("bit", "int"), ("name", "long"), ("label", "long"))))
    steps = steps.select(*group, "turn", F.expr("shiftleft(1, cast(bit as int))").alias("mask"), "gain", step.alias("step"))

    def turn(state: DataFrame, t: int) -> DataFrame:
        now = steps.filter(F.col("turn") == t).drop("turn")
        tried = state.join(now, group).filter(F.col("given").bitwiseAND(F.col("mask")) == 0)
        tried = tried.select(
            *group, "turns", F.col("given").bitwiseOR(F.col("mask")).alias("given"), F.concat("path", F.array("step")).alias("path"),
            (F.col("f1") + F.col("gain")).cast("decimal(25,15)").alias("f1"),
        )
        best = Window.partitionBy(*group, "given").orderBy(F.desc("f1"), F.asc("path"))
        return tried.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")

    done = []
    for t in range(1, clusters + 1):  # a group is done after as many turns as it has labels
        first = turn(first, t)
        done.append(first.filter(F.col("turns") == t))
    whole = reduce(DataFrame.unionByName, done)
    out = whole.select(*group, F.explode("path").alias("x"), F.col("f1").cast("double").alias("f1"))
    return out.select(*group, "x.label", "x.name", "f1")

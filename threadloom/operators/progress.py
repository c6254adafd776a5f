"""Incremental progress: which atoms are new, partly or fully done per section, and what triggers fire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status(atoms: DataFrame, done: DataFrame, sections: list[str]) -> DataFrame:
    """(section, root) with new, partial or finished; done: (section, root, done_count, done_leaf).

    Sections are a few names, spread as an array, so there is no cross join."""
    a = atoms.withColumn("section", F.explode(F.array(*map(F.lit, sections))))
    d = done.select(F.col("section").alias("s"), F.col("root").alias("r"), "done_count", "done_leaf")
    j = a.join(d, (F.col("section") == F.col("s")) & (F.col("root") == F.col("r")), "left").drop("s", "r")
    return j.withColumn("status", F.when(F.col("done_count").isNull(), "new").when(F.col("done_count") >= F.col("n_members"), "finished").otherwise("partial"))


def since() -> Column:
    """Members to skip of a partial atom: those up to the stored leaf's date, if they are as many as were stored; else 0."""
    old = F.size(F.filter("members", lambda m: m["date"] <= F.col("done_leaf")))
    return F.when((F.col("status") == "partial") & (old == F.col("done_count")), old).otherwise(0)


def delta() -> Column:
    """The members to feed: all, or the first and those after `since`."""
    s = F.col("since")
    return F.when(s > 0, F.concat(F.slice("members", 1, 1), F.slice(F.col("members"), s + 1, F.greatest(F.size("members"), F.lit(1))))).otherwise(F.col("members"))


def commit(done: DataFrame, passed: DataFrame) -> DataFrame:
    """done after a pass: the extents of passed atoms replace older ones."""
    new = passed.select("section", "root", F.col("n_members").alias("done_count"), F.col("leaf_date").alias("done_leaf"), F.lit(1).alias("turn"))
    both = done.select("section", "root", "done_count", "done_leaf", F.lit(0).alias("turn")).unionByName(new)
    return both.groupBy("section", "root").agg(F.max_by(F.struct("done_count", "done_leaf"), "turn").alias("d")).select("section", "root", "d.done_count", "d.done_leaf")


def every_days(days: DataFrame, n: int, key: str = "rule") -> DataFrame:
    """Which of the ordered days a rule fires on: the first, then each that is n days after the last fire. (rule, day)"""
    d = days.groupBy(key).agg(F.array_sort(F.collect_set("day")).alias("days"))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("fired"))

    def step(acc: Column, day: Column) -> Column:
        fire = acc["last"].isNull() | (F.datediff(day.cast("date"), acc["last"].cast("date")) >= n)
        return F.struct(F.when(fire, day).otherwise(acc["last"]).alias("last"), F.when(fire, F.array_append(acc["fired"], day)).otherwise(acc["fired"]).alias("fired"))

    return d.select(key, F.explode(F.aggregate("days", start, step)["fired"]).alias("day"))


def overflow_tasks(oversized: DataFrame) -> DataFrame:
    """Pruning tasks: the further over the limit, the more pressing (70 to 100)."""
    return oversized.select(F.col("path").alias("target"), (70 + F.least(F.lit(30), F.floor(30 * F.col("excess") / F.col("char_limit")))).cast("long").alias("priority"), F.concat(F.lit("overflow:"), F.col("path")).alias("dedup_key"))

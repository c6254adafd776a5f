"""Distributed ranks: gapless positions within groups without bringing a group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, keep


def ranked(df: DataFrame, group: str, order: Sequence[str], out: str = "rank") -> DataFrame:
    """df with a long column: the row's position from 0 within its group, by `order`.

    Rows are dealt by ranges of (group, order), so that a large group spreads over tasks; each task numbers its rows, and
    the rows of a group in earlier tasks are counted from one row per task and group (tasks plus groups rows in all).
    The dealt rows are written before they are numbered, so that both uses see the same ranges. Rows that are equal in
    group and order get different positions, in no fixed order. Null groups are one group; an empty table gives an empty
    result; the columns used in between take names that df does not have.
    """
    at = fresh(df, "dealt_at")
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(at, F.monotonically_increasing_id())
    dealt = keep(dealt)
    task, low, before = (fresh(dealt, c) for c in ("dealt_task", "dealt_low", "dealt_before"))
    dealt = dealt.withColumn(task, F.shiftrightunsigned(at, 33))
    starts = dealt.groupBy(group, task).agg(F.min(at).alias(low), F.count("*").alias(before))
    sizes = F.sum(before).over(W.partitionBy(group).orderBy(task).rowsBetween(W.unboundedPreceding, -1))
    starts = starts.withColumn(before, F.coalesce(sizes, F.lit(0))).withColumnRenamed(group, g := fresh(df, "dealt_group")).withColumnRenamed(task, t := fresh(df, "dealt_task_of"))
    joined = dealt.join(starts, F.col(group).eqNullSafe(F.col(g)) & (F.col(task) == F.col(t)))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(before) + F.col(at) - F.col(low)).alias(out))

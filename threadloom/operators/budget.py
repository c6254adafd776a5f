"""Budgets: the split of a window, max-min fair shares, cropping to the newest, and queue draining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

SHARE, ROUND_COST = 0.333, 1500


def share_of(setting: str | None) -> float:
    """The summary share from a setting: default 0.333, within 0.1 and 0.9."""
    try:
        return min(0.9, max(0.1, float(setting)))
    except (TypeError, ValueError):
        return SHARE


def run_budget(window: int, system: int, share: float = SHARE) -> dict[str, int]:
    """Tokens for the summary and for the work of a run; an error where one of them is not positive."""
    part = int(window * share)
    out = {"window": window, "system": system, "summary": part - system, "work": window - part}
    if out["summary"] <= 0 or out["work"] <= 0:
        raise ValueError(f"a window of {window} leaves no room: {out}")
    return out


def allocate(costs: DataFrame, budget: Column, per: list[str], by: str = "section", cost: str = "cost") -> DataFrame:
    """Max-min fair shares of a budget among the rows of each group.

    Ascending by cost, each row may take an equal part of what is left. The first that needs more fixes the share of
    itself and all after it; those before get what they need. One window gives both."""
    w = W.partitionBy(*per).orderBy(cost, by)
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    k = F.row_number().over(w)
    n = F.count("*").over(W.partitionBy(*per))
    fair = F.floor((budget - before) / (n - k + 1))
    d = costs.withColumn("fair", F.greatest(fair, F.lit(0)).cast("long"))
    first = F.min(F.when(F.col(cost) > F.col("fair"), F.struct(F.col(cost).alias("c"), F.col(by).alias("b"), F.col("fair").alias("f")))).over(W.partitionBy(*per))
    d = d.withColumn("first", first)
    late = F.struct(F.col(cost).alias("c"), F.col(by).alias("b")) >= F.struct(F.col("first.c").alias("c"), F.col("first.b").alias("b"))
    return d.withColumn("share", F.when(F.col("first").isNotNull() & late, F.col("first.f")).otherwise(F.col(cost)).cast("long")).drop("fair", "first")


def crop(blocks: DataFrame, budget: Column, header: Column, per: list[str], order: list[str], most: int, body: str = "text") -> DataFrame:
    """The newest blocks of each group that fit a budget: a suffix in order, at least one; blank blocks go.

    Adds running, the cost from the newest, and left_out, how many others the group has. A block costs a token at least, so
    no group needs more than its newest most + 1 rows (most: no budget is larger), and no more of it meet in one task."""
    b = blocks.filter(F.trim(F.coalesce(F.col(body), F.lit(""))) != "").withColumn("cost", X.tokens(body))
    w = W.partitionBy(*per).orderBy(*[F.col(o).desc() for o in order])
    newest = b.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most + 1)
    run = F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0))
    kept = newest.withColumn("running", run).filter((F.col("place") == 1) | (header + F.col("running") <= budget))
    sizes = b.groupBy(*[F.col(c).alias(f"of_{c}") for c in per]).agg(F.count("*").alias("n_blocks"))
    on = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in per]
    joined = kept.withColumn("n_kept", F.count("*").over(W.partitionBy(*per))).join(sizes, on)
    return joined.withColumn("left_out", F.col("n_blocks") - F.col("n_kept")).drop("place", "n_kept", "n_blocks", *[f"of_{c}" for c in per])


def drain(tasks: DataFrame, now: int, cap: int) -> DataFrame:
    """The tasks that a run with a cap of tokens gets to, by priority plus age, with their place: it stops once the tokens
    and the round costs of what it took reach the cap. A round costs, so only so many tasks are put in order."""
    eff = F.col("priority") + 3 * (F.lit(now) - F.col("created_batch"))
    order = [F.col("eff").desc(), F.col("created_batch"), F.col("seq")]
    d = tasks.withColumn("eff", eff).orderBy(*order).limit(cap // ROUND_COST + 2)
    w = W.orderBy(*order)
    before = F.coalesce(F.sum(F.col("tokens") + ROUND_COST).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("place", F.row_number().over(w).cast("long")).withColumn("before", before).filter(F.col("before") < cap).drop("before")


def requeue(taken: DataFrame, failed: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Of the tasks that a run took, those to queue again: what failed (key) for the first time; `tries` counts."""
    t = taken if "tries" in taken.columns else taken.withColumn("tries", F.lit(0))
    return t.join(failed.select(key).distinct(), key, "left_semi").filter("tries = 0").withColumn("tries", F.col("tries") + 1)


def share(setting: Column) -> Column:
    """share_of as a column."""
    v = setting.try_cast("double")
    return F.when(v.isNull(), SHARE).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.1), v)))


def first_of_key(tasks: DataFrame, key: str = "dedup_key", seq: str = "seq") -> DataFrame:
    """Of tasks with the same key, the first."""
    return tasks.withColumn("n_", F.row_number().over(W.partitionBy(key).orderBy(seq))).filter("n_ = 1").drop("n_")

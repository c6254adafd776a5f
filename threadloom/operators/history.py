"""History files of four tiers: which to show, which to roll up.

A day lies in one month, quarter and year, so coverage is an equality of strings, and the taper is a chain of anti-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import text as X
from .lineage import cut


def index(files: DataFrame) -> DataFrame:
    """period, tier, and the coarser periods that hold it."""
    p = F.col("period")
    month = F.when(F.col("tier") == "day", P.month_of(p)).when(F.col("tier") == "month", p)
    quarter = F.when(F.col("tier").isin("day", "month"), P.quarter_of(p)).when(F.col("tier") == "quarter", p)
    return files.withColumn("tier", P.tier("period")).filter("tier is not null").withColumn("month", month).withColumn("quarter", quarter).withColumn("year", P.year_of(p))


def taper(files: DataFrame, today: str) -> DataFrame:
    """(period, tier) of the files to show on a day: years before this one as coarse as there are, then this year's
    earlier quarters, this quarter's earlier months, this month's days; finer tiers stand in for missing ones."""
    this_month, this_year = today[:7], today[:4]
    this_quarter = f"{this_year}-q{(int(today[5:7]) + 2) // 3}"
    live = cut(index(files).filter(X.has_content("body")).select("period", "tier", "month", "quarter", "year"))
    old, past_q = F.col("year") < this_year, (F.col("year") == this_year) & (F.col("quarter") < this_quarter)
    past_m = (F.col("quarter") == this_quarter) & (F.col("month") < this_month)
    zone = F.when(old, 0).when(past_q, 1).when(past_m, 2).when((F.col("tier") == "day") & (F.col("month") == this_month) & (F.col("period") <= today), 3)
    seen = live.withColumn("zone", zone).filter("zone is not null")

    def covers(tier: str, key: str, zones: int) -> DataFrame:
        return seen.filter((F.col("tier") == tier) & (F.col("zone") <= zones)).select(F.col("period").alias(f"by_{key}"), F.lit(tier).alias(f"is_{key}"))

    d = seen.join(covers("year", "year", 0), F.col("year") == F.col("by_year"), "left").join(covers("quarter", "quarter", 1), F.col("quarter") == F.col("by_quarter"), "left").join(covers("month", "month", 2), F.col("month") == F.col("by_month"), "left")
    hidden = ((F.col("tier") != "year") & F.col("by_year").isNotNull()) | (F.col("tier").isin("month", "day") & F.col("by_quarter").isNotNull()) | ((F.col("tier") == "day") & F.col("by_month").isNotNull())
    shown = d.filter(~hidden).select("period", "tier", "zone")
    # nothing of this month by day: its own file, then this quarter's, then this year's
    rest = live.filter(F.col("period").isin(this_month, this_quarter, this_year)).withColumn("want", F.when(F.col("tier") == "month", 1).when(F.col("tier") == "quarter", 2).otherwise(3))
    have = shown.agg(F.coalesce(F.max((F.col("zone") == 3).cast("int")), F.lit(0)).alias("days"), F.coalesce(F.max((F.col("zone") == 2).cast("int")), F.lit(0)).alias("months"))
    # one row beside three: the fallback's candidates
    cand = rest.crossJoin(F.broadcast(have)).filter((F.col("days") == 0) & ((F.col("want") == 1) | (F.col("months") == 0)))
    cand = cand.withColumn("r", F.row_number().over(W.orderBy("want"))).filter("r = 1").select("period", "tier")
    return shown.select("period", "tier").unionByName(cand)


def parts(indexed: DataFrame) -> DataFrame:
    """Files as parts of the next coarser period: (period, tier, part)."""
    t = F.col("tier")
    up = F.when(t == "day", F.struct(F.col("month").alias("period"), F.lit("month").alias("tier"))).when(t == "month", F.struct(F.col("quarter").alias("period"), F.lit("quarter").alias("tier"))).when(t == "quarter", F.struct(F.col("year").alias("period"), F.lit("year").alias("tier")))
    return indexed.select(up.alias("up"), F.col("period").alias("part")).filter("up is not null").select("up.*", "part")


def gaps(files: DataFrame, today: str) -> DataFrame:
    """Finished periods without a file whose parts have files: period, tier and its sorted sources."""
    i = cut(index(files).filter(X.has_content("body")).select("period", "tier", "month", "quarter", "year"))
    now = F.when(F.col("tier") == "month", today[:7]).when(F.col("tier") == "quarter", f"{today[:4]}-q{(int(today[5:7]) + 2) // 3}").otherwise(today[:4])
    g = parts(i).filter(F.col("period") < now).groupBy("period", "tier").agg(F.array_sort(F.collect_set("part")).alias("sources"))
    return g.join(i.select("period"), "period", "left_anti").select("period", "tier", "sources")


def plan(files: DataFrame) -> DataFrame:
    """Every period that has parts, from fine to coarse, with its sorted parts."""
    level = F.when(F.col("tier") == "month", 0).when(F.col("tier") == "quarter", 1).otherwise(2)
    return parts(index(files)).groupBy("period", "tier").agg(F.array_sort(F.collect_set("part")).alias("sources")).select("period", "sources", level.cast("long").alias("level"))


def blocks(files: DataFrame, today: str) -> DataFrame:
    """The view: tapered periods by their start, each under its display name."""
    shown = taper(files, today).select("period")
    return files.join(shown, "period", "left_semi").select("period", P.order_key("period").alias("order_key"), F.concat(F.lit("## "), P.display("period"), F.lit("\n\n"), F.col("body")).alias("text"))

"""Whole plans: batches of a log, and a report of sections that share a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget, chains, identity, rendering


def batched(messages: DataFrame, chat: Column, capacity: int, per: Sequence[str] = ()) -> DataFrame:
    """Messages to sanitised atoms to batches: per chat and batch its atoms, their tokens and the first of them. per: the
    columns by which people are known (see identity.sanitised)."""
    told = identity.sanitised(chains.described(messages), per)
    a = rendering.atom_text(chains.atoms(chains.with_root(told, messages.select("id", "reply_to", "post_id"))))
    a = a.select(chat.alias("chat"), "root", "leaf_date", "leaf_id", X.tokens("content").alias("cost"))
    a = a.withColumn("seq", F.row_number().over(W.partitionBy("chat").orderBy("leaf_date", "leaf_id")).cast("long"))
    packed = chains.batches(a.select("chat", "seq", "cost"), capacity, ["chat"])
    return packed.groupBy("chat", "batch").agg(F.count("*").alias("atoms"), F.sum("cost").alias("tokens"), F.min("seq").alias("first_seq"))


# What a view says where there is nothing, and where older blocks were left out.
EMPTY, TRIMMED = "(none yet)", "_[… %d older item(s) trimmed to fit context …]_"


def title_of(section: Column) -> Column:
    return F.concat(F.lit("# "), F.initcap(F.replace(section, F.lit("_"), F.lit(" "))))


def view_cost(blocks: DataFrame, per: list[str], title: Column, body: str = "body") -> DataFrame:
    """(per..., cost): tokens of the whole view, its title and its blocks joined by blank lines; 0 where all are blank."""
    some = F.trim(F.coalesce(F.col(body), F.lit(""))) != ""
    g = blocks.groupBy(*per).agg(F.sum(F.when(some, F.length(body))).alias("chars"), F.count_if(some).alias("n"))
    whole = F.length(title) + 2 + F.col("chars") + 2 * (F.col("n") - 1)
    return g.select(*per, F.when(F.col("n") > 0, F.greatest(F.lit(1), F.floor(whole / 4))).otherwise(0).cast("long").alias("cost"))


def assembled(blocks: DataFrame, total: int, per: str = "per", section: str = "section", body: str = "body", order: tuple[str, ...] = ("updated", "doc_id"), in_report: list[str] | None = None) -> DataFrame:
    """A text per section: costs, max-min shares of the budget, the newest blocks that fit, and a title.

    Blocks that were left out are counted in a note at the top; a section of blank blocks says that there is none yet.
    in_report: of all sections, those that the report shows (the budget is shared by these)."""
    b = blocks if in_report is None else blocks.filter(F.col(section).isin(in_report))
    b = b.withColumn("title", title_of(F.col(section)))
    costs = view_cost(b, [per, section], title_of(F.col(section)), body)
    shares = budget.allocate(costs, F.lit(total), [per], section).select(F.col(per).alias("p"), F.col(section).alias("s"), "share")
    on = F.col(per).eqNullSafe(F.col("p")) & F.col(section).eqNullSafe(F.col("s"))
    c = budget.crop(b.join(shares, on).drop("p", "s"), F.col("share"), X.tokens("title"), [per, section], list(order), total, body)
    rows = F.array_sort(F.collect_list(F.struct(*order, body)))
    g = c.groupBy(F.col(per).alias("g_per"), F.col(section).alias("g_section")).agg(F.first("left_out").alias("left_out"), rows.alias("rows"))
    g = shares.join(g, F.col("p").eqNullSafe(F.col("g_per")) & F.col("s").eqNullSafe(F.col("g_section")), "left")
    note = F.when(F.col("left_out") > 0, F.array(F.format_string(TRIMMED, "left_out"))).otherwise(F.array().cast("array<string>"))
    shown = F.when(F.col("rows").isNull(), F.array(F.lit(EMPTY))).otherwise(F.concat(note, F.transform("rows", lambda r: r[body])))
    return g.select(F.col("p").alias(per), F.col("s").alias(section), "share", F.array_join(F.concat(F.array(title_of(F.col("s"))), shown), "\n\n").alias("text"))

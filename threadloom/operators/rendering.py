"""Messages, atoms and days as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import chains


def head(date: Column, who: Column) -> Column:
    return F.concat(F.lit("["), X.clock(date), F.lit("] "), who, F.lit(":"))


def spoken(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(" "), text)).otherwise("")


def line(date: Column, who: Column, text: Column, shown: Column | None = None) -> Column:
    """One message: time, speaker, text, and the long form of its media (if any) on a line of its own."""
    out = F.concat(head(date, who), spoken(text))
    return out if shown is None else F.concat(out, F.when(F.coalesce(shown, F.lit("")) != "", F.concat(F.lit(" \n"), shown)).otherwise(""))


def atom_text(atoms: DataFrame, since: Column | None = None) -> DataFrame:
    """Adds content: a line per member and one per slot; from `since` on, the first member and the rest from there."""
    members, names = F.col("members"), atoms.schema["members"].dataType.elementType.names
    if since is not None:
        grown = (since > 0) & (since < F.size("members"))
        members = F.when(grown, F.concat(F.slice("members", 1, 1), F.slice(F.col("members"), since + 1, F.greatest(F.size("members"), F.lit(1))))).otherwise(members)

    def lines(m: Column) -> Column:
        who = m["who"] if "who" in names else X.person_key(m["sender_id"], m["sender_name"])
        first = F.array(F.concat(head(m["date"], who), spoken(m["text"])))
        return F.concat(first, F.transform(m["slots"], lambda s: F.concat(F.lit("  "), s))) if "slots" in names else first

    named = chains.is_named(F.col("source"))
    top = F.when(named, F.array(F.concat(F.lit("[source: "), F.col("source"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    return atoms.withColumn("content", F.array_join(F.concat(top, F.flatten(F.transform(members, lines))), "\n"))


def pictures(parts: Column) -> Column:
    """The description of one picture, or numbered ones of several; parts: array of struct(what, text), where text is
    what is written in the picture."""

    def one(p: Column, head: Column) -> Column:
        text = F.when(F.regexp_replace(F.coalesce(p["text"], F.lit("")), r"\s", "") != "", F.concat(F.lit("\nOCR:\n"), p["text"])).otherwise("")
        return F.concat(F.regexp_replace(F.concat(head, p["what"]), r"\s+$", ""), text)

    many = F.array_join(F.transform(parts, lambda p, i: one(p, F.concat(F.lit("[image "), F.lpad(i.cast("string"), 2, "0"), F.lit("] ")))), "\n\n")
    return F.when(F.size(parts) == 1, F.regexp_replace(one(parts[0], F.lit("")), r"^\s+|\s+$", "")).otherwise(many)


# How a day of a channel sets posts and comments apart.
POST, COMMENT, LOST_POST = "▸ POST — ", "    ↳ ", "▸ POST {} — (post text unavailable)"


def days(messages: DataFrame) -> DataFrame:
    """A text per day: a header, then the messages by date and id; where there are posts, each post and then its comments
    by id, and messages of no post first. A column `shown` is the long form of media."""
    shown = F.col("shown") if "shown" in messages.columns else None
    who = F.col("who") if "who" in messages.columns else X.person_key("sender_id", "sender_name")
    d = chains.by_day(messages).withColumn("line", line(F.col("date"), who, F.col("text"), shown))
    post, none = F.col("id") == F.col("post_id"), F.array().cast("array<string>")
    plain = F.transform(F.array_sort(F.collect_list(F.when(F.col("post_id").isNull(), F.struct("date", "id", "line")))), lambda r: r["line"])
    own = F.max(F.when(post, F.concat(F.lit(POST), "line")))
    comments = F.transform(F.array_sort(F.collect_list(F.when(F.col("post_id").isNotNull() & ~post, F.struct("id", "line")))), lambda r: F.concat(F.lit(COMMENT), r["line"]))
    lost = F.format_string(LOST_POST.replace("{}", "%d"), F.col("post_id"))
    p = d.groupBy("day", "post_id").agg(plain.alias("plain"), own.alias("own"), comments.alias("comments"))
    p = p.withColumn("lines", F.concat("plain", F.when(F.col("post_id").isNotNull(), F.array(F.coalesce("own", lost))).otherwise(none), "comments"))
    g = p.groupBy("day").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("post_id", F.lit(-(2**63))).alias("at"), "lines"))).alias("posts"))
    return g.select("day", F.array_join(F.concat(F.array(F.concat(F.lit("## "), F.col("day"))), F.flatten(F.transform("posts", lambda x: x["lines"]))), "\n").alias("content"))


# The marks between which a reply about a picture puts its two parts.
TEXT_MARK, WHAT_MARK = "===OCR===", "===DESCRIPTION==="


def vision(reply: Column) -> Column:
    """A described picture as struct(what, text): what follows the marks; a reply without marks is text."""

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    at = F.position(F.lit(WHAT_MARK), reply)
    what = F.when(at > 0, F.substring(reply, at + len(WHAT_MARK), F.length(reply))).otherwise("")
    rest = F.when(at > 0, F.substring(reply, F.lit(1), at - 1)).otherwise(reply)
    start = F.position(F.lit(TEXT_MARK), rest)
    text = F.when(start > 0, F.substring(rest, start + len(TEXT_MARK), F.length(rest))).otherwise(rest)
    return F.struct(bare(what).alias("what"), bare(text).alias("text"))

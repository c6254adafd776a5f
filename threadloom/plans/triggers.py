"""Which tasks follow from the state: on launch, on finish, as time passes, and when files grow too long.

A rule's builder gets a context and gives tasks (target, key) as a DataFrame; what fires is decided on the driver, rule by
rule, from one date per rule.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import text as X
from ..operators import history, progress, store

#: Days after which an open offer counts as stale.
STALE = 90
TASK = ("section", "name", "target", "priority", "created_batch", "dedup_key")


@dataclass
class Context:
    """files: (path, body, updated, char_limit); now: the last day processed; boundary: the deadline that was crossed."""

    files: DataFrame
    now: str
    batch: int = 0
    boundary: str | None = None


def diary(files: DataFrame) -> DataFrame:
    """History files as (period, body)."""
    return files.select(F.regexp_extract("path", r"^history/(.+)\.md$", 1).alias("period"), "body").filter("period <> ''")


def rollups(c: Context) -> DataFrame:
    """A task per finished period that has parts and no file."""
    return history.gaps(diary(c.files), c.now).select(F.concat(F.lit("history/"), "period", F.lit(".md")).alias("target"), F.concat(F.lit("rollup:"), "period").alias("key"))


def rebuild(c: Context) -> DataFrame:
    """One task over all periods that have parts."""
    planned = history.plan(diary(c.files).filter(X.has_content("body")))
    return planned.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("history/").alias("target"), F.concat(F.lit("rebuild:"), F.col("n").cast("string")).alias("key"))


def stale_offers(c: Context) -> DataFrame:
    """A task per open offer that was posted long ago."""
    cards = c.files.filter(F.col("path").startswith("job_offers/") & F.col("path").endswith(".json")).withColumn("r", F.from_json("body", "status string, posted_at string"))
    old = (F.coalesce("r.status", F.lit("open")) == "open") & P.is_day("r.posted_at") & (F.datediff(F.lit(c.now).cast("date"), F.try_to_date("r.posted_at", "yyyy-MM-dd")) >= STALE)
    return cards.filter(old).select(F.col("path").alias("target"), F.concat(F.lit("expire:"), "path").alias("key"))


def exams(c: Context) -> DataFrame:
    """A task per file of the current term that is not blank."""
    term = P.term(F.lit(c.now))
    mine = F.col("path").startswith("study/") & F.endswith("path", F.concat(F.lit("/"), term, F.lit(".md")))
    return c.files.filter(mine & (F.trim("body") != "")).select(F.col("path").alias("target"), F.concat(F.lit(f"exam:{c.boundary or ''}:"), "path").alias("key"))


def due(when: str, last: str | None, now: str) -> tuple[bool, str | None]:
    """Whether a rule days:N or deadline:MM-DD,MM-DD fires, and the last deadline that lies in (last, now]."""
    kind, _, rest = when.partition(":")
    if kind == "days":
        return not last or (datetime.date.fromisoformat(now) - datetime.date.fromisoformat(last)).days >= int(rest), None
    if kind == "deadline" and last:
        years = range(int(last[:4]), int(now[:4]) + 1)
        hit = [d for d in sorted(f"{y:04d}-{m}" for y in years for m in rest.split(",")) if last < d <= now]
        return bool(hit), hit[-1] if hit else None
    return False, None


def fire(sections: list, files: DataFrame, now: str, batch: int = 0, last: dict[str, str] | None = None, moments: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """All tasks that the state calls for, and the dates on which rules fired last.

    moments: which of init, launch and finish it is. Every file over its limit gets a task, whatever its section says."""
    fired, parts = dict(last or {}), []

    def add(section, rule, boundary: str | None = None) -> None:
        c = Context(files, now, batch, boundary)
        rows = rule.build(c) if rule.build else files.sparkSession.range(1).select(F.lit("").alias("target"), F.lit(rule.name).alias("key"))
        parts.append(rows.select(F.lit(section.name).alias("section"), F.lit(rule.name).alias("name"), "target", F.lit(rule.priority).cast("long").alias("priority"), F.lit(batch).cast("long").alias("created_batch"), F.concat(F.lit(f"{section.name}:"), "key").alias("dedup_key")))

    for s in sections:
        for r in s.rules:
            if r.when in moments:
                add(s, r)
                continue
            key = f"{s.name}:{r.name}"
            yes, boundary = due(r.when, fired.get(key), now)
            if yes:
                add(s, r, boundary)
                fired[key] = now
    grown = progress.overflow_tasks(store.oversized(files)).withColumn("section", F.coalesce(store.resolve("target")["section"], F.lit("")))
    parts.append(grown.filter("section <> ''").select("section", F.lit("prune").alias("name"), "target", "priority", F.lit(batch).cast("long").alias("created_batch"), "dedup_key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, fired

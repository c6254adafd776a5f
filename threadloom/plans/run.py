"""A run over a log: what is pending, in chunks, with a checkpoint after each; then the report.

State is a folder of Parquet tables per version, and a version counts once its manifest row is written, so a run that
stops at any point resumes from the last whole version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import identity, progress
from .report import assembled

VERSION, FIRST_CHUNK = 3, 24


def next_chunk(size: int, ok: bool) -> int:
    """Twice as many atoms after a success, half after a prompt that was too long, never below one."""
    return size * 2 if ok else max(1, size // 2)


class State:
    TABLES = ("done", "files", "tasks", "fired")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def last(self) -> int | None:
        """The last whole version of this format, if any."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        m = self.spark.read.parquet(f"{self.path}/manifest").filter(F.col("format") == VERSION)
        return m.agg(F.max("version")).collect()[0][0]

    def load(self, name: str) -> DataFrame | None:
        v = self.last()
        return None if v is None else self.spark.read.parquet(f"{self.path}/{v}/{name}")

    def save(self, **tables: DataFrame) -> int:
        v = (self.last() or 0) + 1
        for name in self.TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.path}/{v}/{name}")
        self.spark.range(1).select(F.lit(v).alias("version"), F.lit(VERSION).alias("format")).write.mode("append").parquet(f"{self.path}/manifest")
        return v


def pending(atoms: DataFrame, done: DataFrame, sections: list[str]) -> DataFrame:
    """Atoms that a section has not finished, in order, with the members to feed."""
    s = progress.status(atoms, done, sections).filter("status <> 'finished'").withColumn("since", progress.since())
    return s.withColumn("feed", progress.delta()).orderBy("section", "leaf_date", "leaf_id")


def ingest(work: list, feed: Callable[[list], bool], first: int = FIRST_CHUNK) -> list[tuple[int, bool]]:
    """Feed work in chunks that adapt to what fits; a single item that does not fit counts as forced. (size, forced)"""
    out, at, size = [], 0, first
    while at < len(work):
        chunk = work[at : at + size]
        ok = feed(chunk)
        if ok or len(chunk) == 1:
            out.append((len(chunk), not ok))
            at += len(chunk)
        size = next_chunk(min(size, len(chunk)) if not ok else size, ok)
    return out


def write_report(blocks: DataFrame, messages: DataFrame, total: int, path: str, in_report: list[str] | None = None, done: DataFrame | None = None) -> None:
    """The report, the same with readable labels, the vault and (where given) the progress, in a folder each."""
    people, known = identity.people(messages), identity.handles(messages)
    unknown = identity.strangers(messages, known)
    report = assembled(blocks, total, in_report=in_report)
    report.write.mode("overwrite").parquet(f"{path}/report")
    named = report.select(F.monotonically_increasing_id().alias("id"), "text")
    identity.humanised(named, identity.readable(people, unknown)).select("text").write.mode("overwrite").text(f"{path}/named")
    identity.vault(people, unknown).write.mode("overwrite").json(f"{path}/vault")
    if done is not None:
        done.write.mode("overwrite").json(f"{path}/progress")


def passes(atoms: DataFrame, done: DataFrame, section, limit: int) -> list[str]:
    """Groups of a section that have something pending, in the order in which one pass each takes them; limit: groups that
    one call may plan, the rest follow in the next."""
    todo = section.groups(pending(atoms, done, [section.name]))
    return [r[0] for r in todo.groupBy("group").agg(F.min("leaf_date").alias("at")).orderBy("at", "group").limit(limit).collect()]


def now_iso() -> Column:
    """The time of the query in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")

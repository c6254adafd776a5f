"""Sections: named parts of the report, and how others are added.

A section is a class with columns and DataFrame functions: which paths it owns, a limit, blocks for its view, groups for
ingestion, and rules. A spec is an ordered mapping of names to features.
"""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chains, store
from . import triggers


@dataclass
class Rule:
    """When (entry, finish, days, deadline, overflow, launch) and what tasks follow from the state."""

    when: str
    name: str
    priority: int
    #: From a context (see triggers) to tasks; without one, the rule is one task for the whole section.
    build: Callable | None = None


@dataclass
class Section:
    name: str
    features: dict = field(default_factory=dict)
    in_report: bool = True
    kinds: tuple[str, ...] | None = None
    rules: tuple[Rule, ...] = ()

    def paths_doc(self) -> str:
        """Which paths the section has, and how long a file of each may be."""
        mine = [(pattern, limit) for name, pattern, limit in store.GRAMMAR if name == self.name]
        return "\n".join([f"{self.name}:", *(f"- {pattern} ({limit} characters)" for pattern, limit in mine)])

    def owns(self, path: Column) -> Column:
        return F.coalesce(store.resolve(path)["section"] == self.name, F.lit(False))

    def accepts(self, kinds: Column) -> Column:
        """Whether an atom of these kinds is for the section."""
        return F.lit(True) if self.kinds is None else F.arrays_overlap(kinds, F.array(*map(F.lit, self.kinds)))

    def blocks(self, files: DataFrame) -> DataFrame:
        """path, order_key and text of the section's view: a block per file, or per paragraph of a single file."""
        mine = files.filter(self.owns(F.col("path")))
        return mine.select("path", F.posexplode(F.split("body", "\n\n")).alias("order_key", "text")).filter(F.trim("text") != "")

    def groups(self, atoms: DataFrame) -> DataFrame:
        """Atoms with the group that takes them in one pass."""
        return atoms.withColumn("group", F.lit(self.name))


class People(Section):
    """A profile per person; minor and faded ones in one line each, which are cropped first."""

    TITLES = {"status": "Status", "aka": "Also known as", "personality": "Personality", "positive_to": "Positive to", "negative_to": "Negative to"}

    def blocks(self, files: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        f = files.filter(self.owns(F.col("path"))).select(parts[1].alias("key"), F.regexp_replace(parts[2], r"\.md$", "").alias("part"), F.trim("body").alias("body"), "updated").filter("body <> ''")
        folds = F.max(F.when(F.col("part") == "status", F.col("body")))
        titles = F.create_map(*[F.lit(x) for kv in self.TITLES.items() for x in kv])
        rank = F.create_map(*[F.lit(x) for k, n in enumerate(self.TITLES) for x in (n, k)])
        row = F.struct(F.coalesce(F.try_element_at(rank, F.col("part")), F.lit(99)).alias("r"), F.col("part"), F.concat(F.lit("### "), F.coalesce(F.try_element_at(titles, F.col("part")), F.col("part")), F.lit("\n"), F.col("body")).alias("t"))
        g = f.groupBy("key").agg(folds.alias("status"), F.array_sort(F.collect_list(row)).alias("rows"), F.max("updated").alias("updated"))
        low = F.lower(F.coalesce("status", F.lit("")))
        fold = F.when(low.startswith("minor"), "minor").when(low.startswith("faded"), "faded")
        g = g.withColumn("fold", fold)
        tail = F.trim(F.regexp_replace(F.expr("substring(status, 6)"), r"^[ —\-:]+", ""))
        folded = g.filter("fold is not null").select("fold", "key", F.when(tail == "", F.col("key")).otherwise(F.concat("key", F.lit(" ("), tail, F.lit(")"))).alias("t"))
        folded = folded.groupBy("fold").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "t"))), lambda s: s["t"]), ", ").alias("t"))
        head = F.when(F.col("fold") == "minor", "**Minor participants**\n").otherwise("**Faded**\n")
        full = g.filter("fold is null").select("key", F.col("updated").cast("string").alias("order_key"), F.concat(F.lit("## "), F.col("key"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n\n")).alias("text"))
        return full.unionByName(folded.select(F.col("fold").alias("key"), F.lit("").alias("order_key"), F.concat(head, F.col("t")).alias("text")))

    def groups(self, atoms: DataFrame) -> DataFrame:
        """An atom goes to its last author, and to each real person that it mentions."""
        return chains.by_person(atoms)


class History(Section):
    def groups(self, atoms: DataFrame) -> DataFrame:
        return atoms.withColumn("group", X.day("leaf_date"))


FACTORIES: dict[str, Callable[[dict], Section]] = {}


def register(name: str, factory: Callable[[dict], Section]) -> None:
    FACTORIES[name] = factory


for _name, _kind, _rules in (
    ("people", People, (Rule("entry", "ingest", 100), Rule("finish", "relevance", 20))),
    ("world", Section, (Rule("entry", "ingest", 100),)),
    ("history", History, (Rule("entry", "ingest", 100), Rule("days:90", "rollup", 50, triggers.rollups), Rule("finish", "consolidate", 20, triggers.rebuild))),
    ("key_facts", Section, (Rule("entry", "ingest", 100),)),
    ("job_offers", Section, (Rule("entry", "ingest", 100), Rule("days:30", "expire", 50, triggers.stale_offers))),
    ("companies", Section, (Rule("finish", "consolidate", 20),)),
    ("contacts", Section, (Rule("finish", "consolidate", 20),)),
    ("market", Section, (Rule("entry", "ingest", 100),)),
    ("shortlist", Section, (Rule("entry", "ingest", 99),)),
    ("study", Section, (Rule("entry", "ingest", 100), Rule("deadline:12-01,05-01", "exam", 55, triggers.exams))),
    ("codebase", Section, (Rule("entry", "ingest", 100),)),
    ("insights", Section, (Rule("entry", "ingest", 100), Rule("finish", "synthesise", 20))),
):
    register(_name, lambda features, n=_name, k=_kind, r=_rules: k(n, features, in_report=n != "job_offers", rules=r))


def load_plugins(folder: str) -> list[str]:
    """Import every Python file of a folder, which registers what it brings."""
    names = sorted(n for n in os.listdir(folder) if n.endswith(".py") and not n.startswith("_"))
    for n in names:
        spec = importlib.util.spec_from_file_location(f"threadloom_plugin_{n[:-3]}", os.path.join(folder, n))
        spec.loader.exec_module(importlib.util.module_from_spec(spec))
    return names


DEFAULT = {"people": {}, "world": {}, "history": {}, "key_facts": {}}


def spec_of(chosen: dict | None = None, drop: list[str] | None = None, add: dict | None = None) -> dict[str, dict]:
    """The default, or what is chosen in its place; less what is dropped, plus what is added (at the end)."""
    out = {k: dict(v) for k, v in (chosen or DEFAULT).items()}
    for n in drop or []:
        out.pop(n, None)
    for n, features in (add or {}).items():
        out[n] = {**out.get(n, {}), **features}
    unknown = [n for n in out if n not in FACTORIES]
    if unknown:
        raise ValueError(f"no such section: {', '.join(unknown)}")
    return out


def build(spec: dict[str, dict]) -> list[Section]:
    return [FACTORIES[n](f) for n, f in spec.items()]

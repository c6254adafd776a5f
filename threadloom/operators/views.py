"""Blocks of section views: one row per block, with a key that orders it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paragraphs(files: DataFrame, body: str = "body") -> DataFrame:
    """Blocks of single-file sections: their paragraphs in order."""
    b = files.select(*[c for c in files.columns if c != body], F.posexplode(F.split(body, "\n\n", -1)).alias("position", "text"))
    return b.withColumn("position", F.col("position").cast("long")).filter(F.trim("text") != "")


def pay(mean: Column, variance: Column) -> Column:
    """Yearly pay in thousands, with its spread where that is known."""
    k = lambda c: F.format_string("%.0f", F.bround(c / 1000))
    some = (mean.isNotNull()) & (mean != 0)
    spread = F.when(F.coalesce(variance, F.lit(0.0)) != 0, F.concat(F.lit("±"), k(F.sqrt(variance)), F.lit("k"))).otherwise("")
    return F.when(some, F.concat(F.lit("~$"), k(mean), F.lit("k"), spread, F.lit("/yr"))).otherwise("comp n/a")


def offer(grade: Column, spec: Column, title: Column, company: Column, mean: Column, variance: Column, mode: Column, place: Column, status: Column, tier: Column) -> Column:
    """One line per offer: what, where, pay, place, and what is unusual about it."""
    known = lambda c, unknown: F.when(~c.isin("", unknown), c)
    position = F.concat_ws(" ", known(grade, "unknown"), known(spec, "other"))
    position = F.coalesce(F.nullif(position, F.lit("")), title, F.lit("?"))
    where = F.nullif(F.concat_ws("/", known(mode, "unknown"), known(place, "")), F.lit(""))
    state = F.when(F.coalesce(status, F.lit("open")) != "open", status)
    rank = F.when(~F.coalesce(tier, F.lit("routine")).isin("routine", ""), F.concat(F.lit("["), tier, F.lit("]")))
    head = F.concat(F.lit("**"), position, F.lit("** @ "), F.coalesce(company, F.lit("?")))
    return F.concat(F.lit("- "), F.concat_ws(" — ", head, pay(mean, variance), where, state, rank))


def rendered(blocks: DataFrame, per: list[str], order: list[str], title: str) -> DataFrame:
    """A text per group: a title and its blocks in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "text")))
    g = blocks.groupBy(*per).agg(rows.alias("rows"))
    return g.select(*per, F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n")).alias("text"))


# The schemas of typed records, as far as views show them.
CARD = "posted_at string, company string, specialization string, grade string, title_raw string, reward struct<net_yearly_usd_mean double, variance double>, work_mode string, location string, status string, tier string"
FACTS = "aliases array<string>, domain string, stage string, hq string, remote_policy string, size_est string"
CONTACT = "handle string, kind string, role string, companies array<string>, offers array<string>"


def _under(files: DataFrame, prefix: str, suffix: str = "") -> DataFrame:
    return files.filter(F.col("path").startswith(prefix) & F.col("path").endswith(suffix))


def _cards(files: DataFrame, prefix: str, suffix: str, schema: str) -> DataFrame:
    """Files with their record; what is no object of the schema, or an empty one, is left out."""
    f = _under(files, prefix, suffix).withColumn("c", F.from_json("body", schema))
    return f.filter(F.col("c").isNotNull() & (F.regexp_replace("body", r"\s", "") != "{}"))


def offers(files: DataFrame) -> DataFrame:
    """A line per offer, by posting date: (path, order_key, text). files: (path, body, updated)."""
    c = F.col
    f = _cards(files, "job_offers/", ".json", CARD)
    blank = F.lit("")
    text = offer(F.coalesce(c("c.grade"), blank), F.coalesce(c("c.specialization"), blank), F.nullif(c("c.title_raw"), blank), F.nullif(c("c.company"), blank), c("c.reward.net_yearly_usd_mean"), c("c.reward.variance"), F.coalesce(c("c.work_mode"), blank), F.coalesce(c("c.location"), blank), F.nullif(c("c.status"), blank), c("c.tier"))
    return f.select("path", F.struct(F.coalesce(c("c.posted_at"), blank).alias("at"), c("path").alias("key")).alias("order_key"), text.alias("text"))


def contacts(files: DataFrame) -> DataFrame:
    """A line per contact: handle, kind and role, companies, number of offers; by last update."""
    c = F.col
    f = _cards(files, "contacts/", ".json", CONTACT)
    head = F.concat(F.lit("**"), F.coalesce(F.nullif(c("c.handle"), F.lit("")), c("path")), F.lit("** ("), F.coalesce(c("c.kind"), F.lit("?")), F.lit("/"), F.coalesce(c("c.role"), F.lit("unknown")), F.lit(")"))
    places = F.nullif(F.array_join(c("c.companies"), ", "), F.lit(""))
    n = F.coalesce(F.size("c.offers"), F.lit(0))
    told = F.when(n > 0, F.concat(n.cast("string"), F.lit(" offer(s)")))
    return f.select("path", F.struct(c("updated").alias("at"), c("path").alias("key")).alias("order_key"), F.concat(F.lit("- "), F.concat_ws(" — ", head, places, told)).alias("text"))


def companies(files: DataFrame) -> DataFrame:
    """A block per company folder that says something: facts in one line, then notes; by the later update of the two."""
    c, part = F.col, F.split("path", "/")
    f = _under(files, "companies/").select(part[1].alias("company"), part[2].alias("part"), "body", "updated").filter("company <> ''")
    one = lambda name, col: F.max(F.when(c("part") == name, c(col)))
    at = F.max(F.when(c("part").isin("facts.json", "notes.md"), c("updated")))
    g = f.groupBy("company").agg(one("facts.json", "body").alias("facts"), one("notes.md", "body").alias("notes"), at.alias("at")).withColumn("c", F.from_json("facts", FACTS))
    bits = [F.concat(F.lit(f"{k.replace('_', ' ')}: "), F.nullif(c(f"c.{k}"), F.lit(""))) for k in ("domain", "stage", "hq", "remote_policy", "size_est")]
    aka = F.when(F.size("c.aliases") > 0, F.concat(F.lit("aka: "), F.array_join(c("c.aliases"), ", ")))
    facts, notes = F.nullif(F.concat_ws(" · ", *bits, aka), F.lit("")), F.nullif(F.regexp_replace("notes", r"^\s+|\s+$", ""), F.lit(""))
    text = F.concat_ws("\n", F.concat(F.lit("## "), c("company")), facts, notes)
    return g.filter(facts.isNotNull() | notes.isNotNull()).select("company", F.struct("at", c("company").alias("key")).alias("order_key"), text.alias("text"))


def study(files: DataFrame) -> DataFrame:
    """A block per course and term that is not blank, by year, season (spring first) and course."""
    part = F.split("path", "/")
    f = _under(files, "study/", ".md").filter(F.trim("body") != "").select("path", part[1].alias("course"), F.regexp_replace(F.element_at(part, -1), r"\.md$", "").alias("term"), "body")
    key = F.struct(F.substring("term", 1, 4).cast("long").alias("year"), F.when(F.col("term").endswith("spring"), 0).otherwise(1).alias("season"), "course")
    return f.select("path", key.alias("order_key"), F.concat(F.lit("## "), "course", F.lit(" "), "term", F.lit("\n\n"), "body").alias("text"))


def notes(files: DataFrame, prefix: str, topics: bool = False) -> DataFrame:
    """A block per file under a prefix, by last update; headed by its path, or by its topics (without the file's ending)."""
    rest = F.expr(f"substring(path, {len(prefix) + 1})")
    name = F.replace(F.regexp_replace(rest, r"\.md$", ""), F.lit("/"), F.lit(" › ")) if topics else rest
    body = F.regexp_replace("body", r"^\s+|\s+$", "")
    return _under(files, prefix).filter(body != "").select("path", F.struct(F.col("updated").alias("at"), F.col("path").alias("key")).alias("order_key"), F.concat(F.lit("## "), name, F.lit("\n\n"), body).alias("text"))


def code(files: DataFrame) -> DataFrame:
    return notes(files, "code/")


def insights(files: DataFrame) -> DataFrame:
    return notes(files, "insights/", topics=True)


def persons(files: DataFrame) -> DataFrame:
    """What is on file of each person: files, years with a file, last update."""
    part = F.split("path", "/")
    f = _under(files, "people/").filter(F.size(part) == 3).select(part[1].alias("key"), F.regexp_replace(part[2], r"\.md$", "").alias("part"), "updated")
    years = F.array_sort(F.collect_set(F.when(F.col("part").rlike(r"^\d{4}$"), F.col("part"))))
    return f.groupBy("key").agg(F.count("*").alias("files"), years.alias("years"), F.max("updated").alias("last_updated"))


def company_names(files: DataFrame) -> DataFrame:
    return _under(files, "companies/").select(F.split("path", "/")[1].alias("company")).filter("company <> ''").distinct().orderBy("company")

"""The keyed store: an append-only log of writes, and the state that follows from it.

State is a fold over the log per key. Writes, appends, patches and deletes fold with windows and ordered aggregates; keys
with edits, whose effect depends on the body at that moment, fold over their ordered list of writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def split_path(path: Column | str) -> Column:
    """Segments of a path: trimmed, either slash, no empty ones; null where one is . or .."""
    parts = F.filter(F.transform(F.split(F.replace(F.trim(X.col(path)), F.lit("\\"), F.lit("/")), "/", -1), lambda p: F.trim(p)), lambda p: p != "")
    return F.when((F.size(parts) > 0) & ~F.arrays_overlap(parts, F.array(F.lit("."), F.lit(".."))), parts)


# Path grammars, as section, pattern of the canonical key, soft limit.
GRAMMAR = (
    ("people", r"^people/@u[0-9a-f]{8}/(status|aka|personality|positive_to|negative_to)\.md$", 1800),
    ("people", r"^people/@u[0-9a-f]{8}/\d{4}\.md$", 1500),
    ("world", r"^world\.md$", 5000),
    ("history", r"^history/\d{4}-\d{2}-\d{2}\.md$", 4000),
    ("history", r"^history/\d{4}-\d{2}\.md$", 6000),
    ("history", r"^history/\d{4}-q[1-4]\.md$", 6000),
    ("history", r"^history/\d{4}\.md$", 10000),
    ("key_facts", r"^key_facts\.md$", 5000),
    ("job_offers", r"^job_offers/[^/]+/[^/]+\.json$", 8000),
    ("job_offers", r"^job_offers/[^/]+/[^/]+/notes\.md$", 2500),
    ("companies", r"^companies/[^/]+/facts\.json$", 1500),
    ("companies", r"^companies/[^/]+/notes\.md$", 700),
    ("contacts", r"^contacts/[^/]+\.json$", 1500),
    ("market", r"^market\.md$", 3000),
    ("shortlist", r"^shortlist\.md$", 2500),
    ("study", r"^study/[^/]+/\d{4}-(fall|spring)\.md$", 4000),
    ("codebase", r"^code/[^/]+(/[^/]+)+$", 8000),
    ("insights", r"^insights/[^/]+(/[^/]+)?\.md$", 12000),
)


def resolve(path: Column | str) -> Column:
    """struct(key, section, char_limit, error): a bad path is a value with an error, not a failure."""
    key = F.array_join(split_path(path), "/")
    section, limit = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name, pattern, size in reversed(GRAMMAR):
        section = F.when(key.rlike(pattern), name).otherwise(section)
        limit = F.when(key.rlike(pattern), size).otherwise(limit)
    error = F.when(key.isNull(), "bad path").when(section.isNull(), "no section owns this path")
    return F.struct(key.alias("key"), section.alias("section"), limit.alias("char_limit"), error.alias("error"))


#: Operations that only prose takes, and those that bring a file about.
PROSE, MAKES = ("write", "append", "edit"), ("touch", "write", "append")


def is_typed(key: Column) -> Column:
    """Typed records are set field by field, prose is written."""
    return F.coalesce(key.endswith(".json"), F.lit(False))


def shown(files: DataFrame, prompt: Column) -> DataFrame:
    """Files (key, body) with `shown`: whether a prompt holds the whole body, so that a run knows the file."""
    return files.withColumn("shown", F.coalesce((F.col("body") != "") & F.contains(prompt, F.col("body")), F.lit(False)))


def checked(ops: DataFrame, files: DataFrame) -> DataFrame:
    """Operations of a run (path, seq, op, overwrite, fields, old) with key and error; null: the operation holds.

    files: (key, shown) of what is there before the run. A file is there from its first touch, write or append on; it is
    known if the prompt shows it, once it was read, or since the run itself made it. So each verdict follows from what
    came before on the same key, by one window."""
    r = resolve("path")
    o = ops.withColumn("r", r).withColumns({"key": F.col("r.key"), "bad": F.col("r.error")}).drop("r")
    before = files.select(F.col("key").alias("file"), F.coalesce("shown", F.lit(False)).alias("shown"))
    o = o.join(before, F.col("key") == F.col("file"), "left")
    w = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    made = F.coalesce(F.max(F.col("op").isin(*MAKES)).over(w), F.lit(False))
    read = F.coalesce(F.max(F.col("op") == "read").over(w), F.lit(False))
    there = F.col("file").isNotNull() | made
    known = F.coalesce("shown", F.lit(False)) | read | (F.col("file").isNull() & made)
    op, typed = F.col("op"), is_typed(F.col("key"))
    error = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(op.isin(*PROSE) & typed, "typed record: patch it")
        .when((op == "patch") & ~typed, "prose: write, append or edit it")
        .when((op == "patch") & (F.coalesce(F.col("fields"), F.lit(0)) == 0), "no fields")
        .when(op.isin("touch") & there, "exists")
        .when((op == "write") & there & ~F.coalesce(F.col("overwrite"), F.lit(False)), "exists")
        .when((op == "edit") & ~there, "does not exist")
        .when(op.isin(*PROSE) & there & ~known, "unseen: read it first")
        .when((op == "edit") & (F.coalesce(F.col("old"), F.lit("")) == ""), "nothing to replace")
    )
    return o.withColumn("error", error).drop("bad", "file", "shown")


def read(paths: DataFrame, files: DataFrame) -> DataFrame:
    """paths (path) with key and body: the empty text where there is no such file, null for a path that nothing owns."""
    p = paths.withColumn("r", resolve("path")).withColumns({"key": F.when(F.col("r.error").isNull(), F.col("r.key"))}).drop("r")
    f = files.select(F.col("key").alias("file"), F.col("body").alias("held"))
    return p.join(f, F.col("key") == F.col("file"), "left").withColumn("body", F.when(F.col("key").isNotNull(), F.coalesce("held", F.lit("")))).drop("file", "held")


def listed(files: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Keys under a prefix, sorted."""
    return files.filter(F.col(key).startswith(prefix)).select(key).orderBy(key)


def bodies(log: DataFrame) -> DataFrame:
    """Key and body: what was written last, and what was appended since, joined by blank lines. A delete empties it."""
    w = W.partitionBy("key").orderBy("seq")
    reset = F.last(F.when(F.col("op").isin("write", "delete"), F.col("seq")), ignorenulls=True).over(W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    live = log.withColumn("reset", reset).filter(F.col("op").isin("write", "append") & (F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))))
    parts = F.array_sort(F.collect_list(F.struct("seq", "body")))
    return live.groupBy("key").agg(parts.alias("p")).select("key", F.array_join(F.transform("p", lambda s: s["body"]), "\n\n").alias("body"))


def patched(log: DataFrame, fields: list[str]) -> DataFrame:
    """Key and, per field, the last value given by a write or patch (null: not given)."""
    return log.groupBy("key").agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])


def folded(log: DataFrame) -> DataFrame:
    """Key and body for logs with edits (old, new): each replaces the first occurrence at its moment."""
    ops = F.array_sort(F.collect_list(F.struct("seq", "op", "body", "old", "new")))

    def step(acc: Column, o: Column) -> Column:
        at = F.position(o["old"], acc)
        edited = F.when(at > 0, F.trim(F.overlay(acc, o["new"], at, F.length(o["old"])))).otherwise(acc)
        return F.when(o["op"] == "write", o["body"]).when(o["op"] == "delete", F.lit("")).when(o["op"] == "append", F.when(acc == "", o["body"]).otherwise(F.concat(acc, F.lit("\n\n"), o["body"]))).when(o["op"] == "edit", edited).otherwise(acc)

    return log.groupBy("key").agg(ops.alias("ops")).select("key", F.aggregate("ops", F.lit(""), step).alias("body"))


def last_updated(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.max("chat_time").alias("last_updated"))


def oversized(files: DataFrame) -> DataFrame:
    """Files over their limit, with the excess."""
    return files.withColumn("excess", (F.length("body") - F.col("char_limit")).cast("long")).filter("excess > 0")


NUMERIC = ("bigint", "int", "double", "float", "decimal", "smallint", "tinyint")


def condition(df: DataFrame, field: str, want) -> Column:
    """A condition of a query: a list means membership, a bool or number equality, a string with > < >= <= a numeric
    comparison (false where either side is no number), any other string a substring regardless of case."""
    c, kind = F.col(field), dict(df.select(F.col(field).alias("c")).dtypes)["c"]
    if isinstance(want, list):
        return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, want))) if kind.startswith("array") else c.isin(want), F.lit(False))
    if isinstance(want, bool) or not isinstance(want, str):
        return c.eqNullSafe(F.lit(want))
    want = want.strip()
    for op in (">=", "<=", ">", "<"):
        if want.startswith(op):
            try:
                n = float(want[len(op) :])
            except ValueError:
                return F.lit(False)
            if not kind.startswith(NUMERIC):
                return F.lit(False)
            return F.coalesce({">=": c >= n, "<=": c <= n, ">": c > n, "<": c < n}[op], F.lit(False))
    return F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lower(F.lit(want)))


def query(records: DataFrame, prefix: str = "", where: dict | None = None, sort: str | None = None, limit: int | None = 20) -> DataFrame:
    """Records under a prefix that meet all conditions; sorted by a field (-field: descending, nulls first), then key."""
    out = records.filter(F.col("key").startswith(prefix)) if prefix else records
    for field, want in (where or {}).items():
        out = out.filter(condition(records, field, want))
    order = [F.col("key")]
    if sort:
        order.insert(0, F.col(sort[1:]).desc_nulls_first() if sort.startswith("-") else F.col(sort).asc_nulls_last())
    out = out.orderBy(*order)
    return out if limit is None or limit < 0 else out.limit(limit)


def dumped(records: DataFrame, fields: list[str]) -> DataFrame:
    """Key and canonical JSON, fields in the schema's order."""
    return records.select("key", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))


def parsed(files: DataFrame, schema: str) -> DataFrame:
    """Key and record; null where the body is no JSON object of the schema."""
    return files.select("key", F.from_json("body", schema).alias("record"))

"""Typed records: constraints as columns, errors as values, patches that are validated after the merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Errors that a record reports at most.
MOST_ERRORS = 8


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    required: bool = False
    values: tuple[str, ...] | None = None
    least: float | None = None


def errors(fields: list[Field]) -> Column:
    """An array of messages, one per constraint that a row breaks; empty where it is valid."""
    found = []
    for f in fields:
        c = F.col(f.name)
        if f.required:
            found.append(F.when(c.isNull(), F.lit(f"{f.name}: missing")))
        if f.values:
            found.append(F.when(c.isNotNull() & ~c.isin(*f.values), F.concat(F.lit(f"{f.name}: not one of {len(f.values)} values: "), c.cast("string"))))
        if f.least is not None:
            found.append(F.when(c < f.least, F.lit(f"{f.name}: below {f.least:g}")))
    return F.slice(F.array_compact(F.array(*found)), 1, MOST_ERRORS)


def patch(current: DataFrame, given: DataFrame, fields: list[Field], key: str = "key") -> DataFrame:
    """current with given's non-null fields over it, and the errors of the result; rows with errors keep what they had."""
    g = given.select(F.col(key).alias("g_key"), *[F.col(f.name).alias(f"g_{f.name}") for f in fields])
    both = current.join(g, F.col(key) == F.col("g_key"), "full").withColumn(key, F.coalesce(key, "g_key"))
    merged = both.select(key, *[F.col(f.name).alias(f"old_{f.name}") for f in fields], *[F.coalesce(f"g_{f.name}", f.name).alias(f.name) for f in fields])
    out = merged.withColumn("errors", errors(fields))
    bad = F.size("errors") > 0
    return out.select(key, *[F.when(bad, F.col(f"old_{f.name}")).otherwise(F.col(f.name)).alias(f.name) for f in fields], "errors")

"""Mixing sources to target weights by Pareto order sampling.

Targets: sources (by code point, null last) weigh 3, 1, 2, repeating, and share a part of all words; a target stops at a
limit of its source's words, and the excess is shared again by weight (water-filling).

A document's expected copies are its source's target over its source's words, tilted by a weight per size class and
capped at the limit. The whole part is certain: that many copies are taken. The rest is its inclusion probability p:
documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of the row, and the first ones are taken until the source
has its words. The prefix is found by counting words over ever finer steps of the rank, so no source is ever sorted in
one task; only the documents of the last step, one in 2 ** 24 of a source, are put in order. The rank's next document no
longer fits whole; the gap that it leaves is filled by documents not drawn, of those with a chance, the nearest in size
first, for as long as one makes the gap smaller.

Cases: a text without words has size 0 and is never taken; null and empty sources are sources of their own; null ids and
equal ids are documents each, told apart by their texts; rows that are equal in id, source and text are told apart by
numbers that they get without meeting in one task, and equal ranks go by these; a source of no words has target 0; an
empty table gives an empty result; columns of docs keep their names and values, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, small
from .ranks import ranked

WEIGHTS, SHARE, LIMIT = (3.0, 1.0, 2.0), 1.5, 2.0
#: Tilt of expected copies by size class (log2 of the words): short documents a little more, long ones a little less.
TILT = 0.05
#: Steps of the rank: two levels of this many.
STEPS = 4096
SEED = "mixing 1"


def water_fill(words: list[int], weights: list[float], total: float, limit: float = LIMIT) -> list[float]:
    """total shared by weight, no share above limit times its words; the excess goes to the others by weight."""
    out = [0.0] * len(words)
    rest = sorted((k for k in range(len(words)) if words[k]), key=lambda k: limit * words[k] / weights[k])
    left, weight = total, sum(weights[k] for k in rest)
    for k in rest:
        out[k] = min(limit * words[k], left * weights[k] / weight)
        left -= out[k]
        weight -= weights[k]
    return out


def tilted(classes: list[tuple[int, int]], target: float, limit: float = LIMIT, tilt: float = TILT) -> dict[int, float]:
    """Expected copies per size class, in proportion to 1 - tilt * class but at most limit, so that their words make target.

    classes: (class, words) of one source."""
    total = sum(w for _, w in classes)
    if target >= limit * total:
        return {c: limit for c, _ in classes}
    shape = {c: max(0.1, 1 - tilt * c) for c, _ in classes}
    low, high = 0.0, limit / 0.1
    for _ in range(100):
        mid = (low + high) / 2
        if sum(w * min(limit, mid * shape[c]) for c, w in classes) < target:
            low = mid
        else:
            high = mid
    return {c: min(limit, high * shape[c]) for c, _ in classes}


def word_count(text: str) -> Column:
    """Runs of anything but ASCII white space, in the JVM."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def told_apart(df: DataFrame, key: str = "k", source: str = "s", text: str = "t") -> DataFrame:
    """df without text, with `row`: a hash of key, source and text, and `number`: 0, 1, 2... for rows equal in these.

    Few rows repeat, and only these are dealt out to be numbered."""
    rows = df.withColumn("row", F.xxhash64(F.lit(SEED), F.col(key).cast("string"), source, text)).drop(text)
    again = keep(rows.groupBy("row").count().filter("count > 1").select("row"))
    if again.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("long"))
    again = small(again)
    single = rows.join(again, "row", "left_anti").withColumn("number", F.lit(0).cast("long"))
    return single.unionByName(ranked(rows.join(again, "row", "left_semi"), "row", ["size"], "number"))


class Mix:
    """What a fitted mix knows: small tables per source, and expressions that decide each row by itself."""

    def __init__(self, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT):
        """sizes (k, s, size, row, number): narrow and written. What reaches the driver: words per source and size class (64
        per source at most)."""
        rows = sizes.groupBy("s", _size_class().alias("c")).agg(F.sum("size").alias("w")).collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r["s"], []).append((r["c"], r["w"]))
        # strings compare by code point in Python
        names = sorted((s for s in by if s is not None), key=str) + ([None] if None in by else [])
        words = [sum(w for _, w in by[s]) for s in names]
        targets = water_fill(words, [weights[k % len(weights)] for k in range(len(names))], share * sum(words), limit)
        plan = [(s, c, words[k], targets[k], e) for k, s in enumerate(names) for c, e in tilted(sorted(by[s]), targets[k], limit).items()]
        self.plan = small(sizes.sparkSession.createDataFrame(plan, f"p_source {dict(sizes.dtypes)['s']}, p_class int, source_size long, target double, expected double"))
        df = keep(self._prepared(sizes))
        gaps = df.groupBy(F.col("s").alias("g")).agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("gap"))
        first = keep(self._crossing(_coarse(), df, gaps, "cross"))
        self.first = small(first.select(F.col("g").alias("g1"), F.col("cross").alias("cross1")))
        inside = self._with_first(df).filter(_coarse() == F.col("cross1")).drop("cross1")
        second = keep(self._crossing(F.col("step"), inside, first.select("g", "gap"), "cross"))
        self.second = small(second.select(F.col("g").alias("g2"), F.col("cross").alias("cross2")))
        # the few documents of the last step, in order
        last = inside.join(small(second), F.col("s").eqNullSafe(F.col("g")) & (F.col("step") == F.col("cross")))
        run = F.sum("size").over(W.partitionBy("g").orderBy("odds", "row", "number").rowsBetween(W.unboundedPreceding, 0))
        self.single = keep(last.withColumn("run", run).filter(F.col("run") <= F.col("gap") + 1e-6).select(F.col("row").alias("row1"), F.col("number").alias("number1")))
        self.drawn = keep(self._drawn(df))
        while True:
            more = keep(self._fitting())
            if more.isEmpty():
                break
            self.single = keep(self.single.unionByName(more))
            self.drawn = keep(self._drawn(df))

    def _prepared(self, df: DataFrame) -> DataFrame:
        """Adds source_size, target, certain copies, and the odds and step of the row's rank (null: no chance)."""
        df = df.join(self.plan, F.col("s").eqNullSafe(F.col("p_source")) & (_size_class() == F.col("p_class")))
        certain = F.floor(F.col("expected") + 1e-12).cast("int")
        prob = F.greatest(F.col("expected") - certain, F.lit(0.0))
        u = (F.pmod(F.xxhash64(F.lit(SEED), "row", "number"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        fine = STEPS * STEPS
        some = F.col("size") > 0
        odds = F.when((prob > 1e-9) & some, (u / (1 - u)) / (prob / (1 - prob)))
        step = F.least(F.floor(odds / (1 + odds) * fine), F.when(odds.isNotNull(), F.lit(fine - 1))).cast("long")
        return df.withColumn("step", step).withColumn("odds", odds).withColumn("certain", F.when(some, certain).otherwise(0)).drop("p_source", "p_class", "expected")

    def _crossing(self, part: Column, inside: DataFrame, gaps: DataFrame, at: str) -> DataFrame:
        """Per source the first step that no longer fits whole, and the gap before it. Rows: STEPS per source at most."""
        sums = inside.filter(F.col("step").isNotNull()).groupBy(F.col("s").alias("g"), part.alias(at)).agg(F.sum("size").alias("w"))
        run = F.sum("w").over(W.partitionBy("g").orderBy(at))
        sums = sums.withColumn("run", run).join(gaps.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")))
        return sums.filter(F.col("run") > F.col("gap") + 1e-6).groupBy("g").agg(F.min(at).alias(at), F.min_by(F.col("gap") - F.col("run") + F.col("w"), at).alias("gap"))

    def _with_first(self, df: DataFrame) -> DataFrame:
        return df.join(self.first, F.col("s").eqNullSafe(F.col("g1")), "left").drop("g1")

    def _drawn(self, df: DataFrame) -> DataFrame:
        """Adds drawn: whether the prefix, the last step's part of it, or the filling of the gap takes the row once more."""
        df = self._with_first(df).join(self.second, F.col("s").eqNullSafe(F.col("g2")), "left")
        df = df.join(small(self.single), (F.col("row") == F.col("row1")) & (F.col("number") == F.col("number1")), "left")
        inside = F.when(F.col("cross1").isNull(), True).when(_coarse() != F.col("cross1"), _coarse() < F.col("cross1")).when(F.col("cross2").isNull(), True).otherwise(F.col("step") < F.col("cross2"))
        drawn = F.col("step").isNotNull() & (inside | F.col("row1").isNotNull())
        return df.withColumn("drawn", drawn.cast("int")).drop("cross1", "g2", "cross2", "row1", "number1")

    def _fitting(self) -> DataFrame:
        """(row1, number1) of rows that make their source's gap smaller: of the size nearest to the gap as many as fit, or one.

        A sample by the row's hash bounds the rows that are put in order; if it holds too few, the next call finds more."""
        left = self.drawn.groupBy(F.col("s").alias("g")).agg((F.first("target") - F.sum((F.col("certain") + F.col("drawn")) * F.col("size"))).alias("left"))
        rest = self.drawn.filter((F.col("drawn") == 0) & F.col("step").isNotNull())
        sizes = rest.groupBy(F.col("s").alias("h"), F.col("size").alias("one")).agg(F.count("*").alias("n"))
        off = F.abs(F.col("left") - F.col("one"))
        sizes = sizes.join(small(keep(left)), F.col("h").eqNullSafe(F.col("g"))).filter(off < F.col("left") - 1e-6)
        best = sizes.groupBy("g").agg(F.min(F.struct(off.alias("off"), "one", "n", F.greatest(F.floor(F.col("left") / F.col("one")), F.lit(1)).alias("most"))).alias("b")).select("g", "b.*")
        some = rest.join(small(keep(best)), F.col("s").eqNullSafe(F.col("g")) & (F.col("size") == F.col("one")))
        drawn = F.pmod(F.xxhash64(F.lit("fill"), "row", "number"), F.lit(1 << 30)) / float(1 << 30) < (4 * F.col("most") + 64) / F.col("n")
        place = F.row_number().over(W.partitionBy("g").orderBy("step", "row", "number"))
        return some.filter(drawn).withColumn("place", place).filter(F.col("place") <= F.col("most")).select(F.col("row").alias("row1"), F.col("number").alias("number1"))

    def _final(self, drawn: DataFrame) -> DataFrame:
        return drawn.withColumn("copies", F.col("certain") + F.col("drawn")).drop("certain", "step", "odds", "drawn")

    def taken(self) -> DataFrame:
        """The fitted rows with source_size, target and copies."""
        return self._final(self.drawn)

    def apply(self, df: DataFrame) -> DataFrame:
        """The same for a wider table of the same rows; nothing but small tables is joined, so texts stay where they are."""
        return self._final(self._drawn(self._prepared(df)))


def _size_class() -> Column:
    return F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double"))).cast("int")


def _coarse() -> Column:
    return F.floor(F.col("step") / STEPS).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with docs' columns."""
    parts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), word_count(f"`{text}`").alias("size"), F.col(f"`{text}`").alias("t"))
    parts = told_apart(parts)
    fitted = Mix(keep(parts.select("k", "s", "size", "row", "number")))
    return fitted.apply(parts).filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op2(docs: DataFrame) -> DataFrame:
    """The query: words taken per document."""
    parts = docs.select(F.col("doc_id").alias("k"), F.col("source").alias("s"), word_count("text").alias("size"), F.col("text").alias("t"))
    out = Mix(keep(told_apart(parts))).taken()
    return out.select(F.col("k").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))

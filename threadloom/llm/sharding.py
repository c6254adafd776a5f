"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Shards stand on the ring at many virtual nodes; a key belongs to the first node clockwise from its hash. Each shard has a
bound on its load; keys that overflow a full shard continue clockwise to the next one with room. Bounds are the row
count divided by the shards, rounded down or up so that they sum to the rows: balance is exact (law `rows`), and only
overflowing keys move away from their first shard.

Only the counts of the ring's arcs (shards times virtual nodes) reach the driver. It walks the ring over counts and
returns, per arc, ranges of ranks with their shard and first slot; rows meet the ranges by their rank within the arc.

Cases: a null key hashes as the empty text; rows with equal keys share an arc and may overflow one by one; a null text
has size 1; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep
from .ranks import ranked

SHARDS, VIRTUAL = 16, 128
#: The ring's length; hashes are taken from it.
RING = 1 << 31


def ring(shards: int = SHARDS, virtual: int = VIRTUAL) -> tuple[list[int], list[int]]:
    """Places of the virtual nodes in clockwise order, and the shard of each."""
    nodes = sorted((xxhash.xxh64_intdigest(f"shard {s} node {v}") % RING, s) for s in range(shards) for v in range(virtual))
    return [p for p, _ in nodes], [s for _, s in nodes]


def bounds(rows: int, shards: int) -> list[int]:
    """Loads that sum to rows, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, shard, first slot, rows): where the rows of each arc go.

    First every arc fills its own shard, clockwise from 0. What overflows then moves from arc to arc, all at once, and
    fills what room the next shard has, until nothing is left; room sums to the rows, so at most one turn is needed.
    """
    room, used, out = list(room), [0] * len(room), []
    n = len(counts)
    moving = [[(a, 0, c)] if c else [] for a, c in enumerate(counts)]
    for _ in range(n + 1):
        if not any(moving):
            break
        nxt: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for at, parts in enumerate(moving):
            s = owner[at]
            for arc, rank, rows in parts:
                take = min(rows, room[s])
                if take:
                    out.append((arc, rank, s, used[s], take))
                    room[s] -= take
                    used[s] += take
                if rows > take:
                    nxt[(at + 1) % n].append((arc, rank + take, rows - take))
        moving = nxt
    return sorted(out)


def shard(df: DataFrame, key: str, tie: str, shards: int = SHARDS, virtual: int = VIRTUAL, room: list[int] | None = None) -> DataFrame:
    """df with shard, slot (gapless from 0 in its shard) and first_shard; names that df has already get _1. tie: a column that
    orders rows of equal keys."""
    places, owner = ring(shards, virtual)
    hashed = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(RING))

    def arcs(h: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(places, h.to_numpy(zero_copy_only=False), side="left") % len(places), pa.int32())

    arcs.__annotations__ = {"h": pa.Array, "return": pa.Array}
    at, arc, rank, placed = (fresh(df, c) for c in ("ring_hash", "ring_arc", "ring_rank", "ring_place"))
    rows = keep(df.withColumn(at, hashed).withColumn(arc, F.arrow_udf(arcs, "int")(F.col(at))))
    counts = [0] * len(places)
    for a, n in rows.groupBy(arc).count().collect():
        counts[a] = n
    ranges = walk(counts, owner, room or bounds(sum(counts), shards))
    span = max(counts, default=0) + 1
    starts = [a * span + r for a, r, *_ in ranges]

    def place(arc: pa.Array, rank: pa.Array) -> pa.Array:
        r = rank.to_numpy(zero_copy_only=False)
        x = arc.to_numpy(zero_copy_only=False).astype(np.int64) * span + r
        t = np.array(ranges, np.int64).reshape(-1, 5)
        i = np.searchsorted(np.array(starts, np.int64), x, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(t[i, 2], pa.int32()), pa.array(t[i, 3] + r - t[i, 1], pa.int64()), pa.array(np.array(owner)[t[i, 0]], pa.int32())], names=["shard", "slot", "first"])

    place.__annotations__ = {"arc": pa.Array, "rank": pa.Array, "return": pa.Array}
    found = ranked(rows, arc, [at, key, tie], rank).withColumn(placed, F.arrow_udf(place, "shard int, slot long, first int").asNondeterministic()(arc, rank))
    names = [fresh(df, c) for c in ("shard", "slot", "first_shard")]
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{placed}.{f}").alias(n) for f, n in zip(("shard", "slot", "first"), names)])


def lookup(key: str, places: list[int], owner: list[int], digest) -> int:
    """The shard that a key belongs to before any overflow; digest gives its place."""
    return owner[bisect.bisect_left(places, digest(key)) % len(places)]


def op7(docs: DataFrame) -> DataFrame:
    """The query: law `rows`. Texts are read once, for sizes and checksums."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shard(narrow, "doc_id", "text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "first_shard")

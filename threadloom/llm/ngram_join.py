"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct word shingles, hashed. Two documents link when 100 * intersection >= percent * union.

Hashed tokens fall into groups. Counts per group make a document a point; the overlap of two documents is at most the sum
of the smaller coordinates. R-trees over points prune whole boxes by the same bound (with the boxes' upper corners), and
pairs that survive are verified on their token sets.

Which documents meet in a tree: sets of similar size are cut into more groups than linked sets can differ in, so linked
documents have at least one group with the same, non-empty content (size classes; groups found empty in one document are
made up for by spare groups, or by a second cut). A key per group's content brings them together. Each document is first
verified against the least one of its keys, which connects most bodies of copies. Trees then search the keys whose
documents are in several components still. A tree looks at a pair only if its key is the least one that the two share,
skips what is connected, and returns at most LAYERS spanning forests of candidates: its rows follow its documents, not
their square. Trees that had more run again with more layers, over the components found meanwhile, until none has; so
every pair that shares a key is connected by verified links, ruled out by the bound, or verified. A key met by more than
TILE documents is cut into tiles by component: tiles of one component are never searched against each other.

Equal sets are one node throughout, named by a 64-bit hash of the set.

Cases: null texts and texts without words have no shingle, link with nothing and are their own component; texts of fewer
words than a shingle have one, the whole sequence; ids may be of any type that Spark can order; rows with equal ids are
one document, which links by the text of each of its rows; rows with a null id take part under no id: their component is
null, and they neither link nor lend keys to others; an empty table gives an empty result. Columns of docs other than id
and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, keep, over_texts, small, tidy

#: Words of a shingle, and the similarity from which documents link, unless a caller says otherwise.
SHINGLE, PERCENT = 5, 80
#: The same for the query op9.
OP9 = (4, 85)
#: Growth of size classes, spare groups per group, cuts tried.
CLASS_GROWTH, SPARE, CUTS = 1.5, 0.1, 6
#: Documents of one key that one tile holds.
TILE = 2048
#: Entries of a tree node.
FAN = 16
#: Spanning forests of candidates that a tree returns in the first round, and how much more in each further one.
LAYERS, MORE = 8, 8
#: Keys of a document that go with each of its rows, the least ones: a pair whose least shared key is none of these is looked
#: at under several keys, and counts once all the same.
LEAST = 32
#: One document in so many is drawn to find keys that are met often, and how often that is.
SAMPLE, OFTEN = 64, 16
#: Parts of a key that is met often.
PARTS = 64
#: Edges that one task contracts.
EDGES = 1_000_000
#: Groups of a point at most.
GROUPS = 512
#: Words whose hash a Python worker remembers.
MEMORY = 60_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_B, _C = (np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_A = np.uint64(0x9E3779B97F4A7C15)
_words: dict[bytes, int] = {}
_seen: dict[int, set] = {}


def _mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _B
    h ^= h >> np.uint64(29)
    h *= _C
    return h ^ h >> np.uint64(32)


def _word(w: bytes) -> int:
    h = _words.get(w)
    if h is None:
        h = xxhash.xxh3_64_intdigest(w)
        if len(_words) < MEMORY:
            _words[w] = h
    return h


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_word, words), np.uint64, n)
    g = h[: n - size + 1] * _A
    for k in range(1, size):
        g = (g ^ h[k : n - size + 1 + k]) * (_B if k % 2 else _C)
    return np.unique(_mix(g))


_classes: dict[int, list[tuple[int, int, int, int]]] = {}


def size_class(n: int, percent: int = PERCENT) -> int:
    """The class of n shingles; _classes[percent] gets (least, most, groups, spare)."""
    classes = _classes.setdefault(percent, [])
    while len(classes) < 2 or classes[-2][1] < n:  # the next class is there, too
        low = classes[-1][1] + 1 if classes else 1
        high = int(low * CLASS_GROWTH) if classes else 99 // max(1, 100 - percent)
        differ = 2 * high * (100 - percent) // (100 + percent)
        spare = -(-(differ + 1) * SPARE // 1)
        classes.append((low, high, differ + 1 + int(spare), int(spare)))
    return bisect_right(classes, n, key=lambda c: c[0]) - 1


def group_keys(g: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """A key per non-empty group, for each class in which the set can meet a linked one.

    In the first class sets are so small that linked ones are equal."""
    n = len(g)
    own = size_class(n, percent)
    out = []
    for c in (own, own + 1):
        low, high, k, spare = _classes[percent][c]
        if c == 0 or c > own and 100 * n < percent * low:
            continue
        content = _mix(g, 99)
        for cut in range(CUTS):
            part = ((_mix(g, 1 + cut) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(part, minlength=k)
            total = np.zeros(k, np.uint64)
            np.add.at(total, part, content)
            key = _mix(total * _A + (np.arange(k).astype(np.uint64) << np.uint64(24)) + np.uint64(c << 8 | cut), 7)
            empty = int((count == 0).sum())
            last = empty > spare and cut == CUTS - 1
            out.append(key if last else key[count > 0])
            if empty <= spare:
                break
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def point(g: np.ndarray) -> bytes:
    """Counts per group of hashes, stored as bytes where none is above 255 (else with four bytes each, after a mark).

    The number of groups is a power of 2 near half of the set (at most GROUPS), so that points fold; finer ones bound more sharply."""
    groups = min(GROUPS, 1 << max(4, (len(g) // 2).bit_length()))
    counts = np.bincount((g & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"wide" + counts.astype("<u4").tobytes()


def fold(points: list[bytes]) -> np.ndarray:
    """Points over the fewest groups among them, as rows, in the narrowest type that holds them."""
    rows = [np.frombuffer(p[4:], "<u4") if p[:4] == b"wide" else np.frombuffer(p, np.uint8) for p in points]
    least = min(map(len, rows))
    out = np.stack([p if len(p) == least else p.reshape(-1, least).sum(0, dtype=np.int64) for p in rows])
    return out.astype(np.uint8 if out.max(initial=0) < 256 else np.int32)


def least_overlap(total, percent: int = PERCENT):
    """The least intersection with which sets of sizes summing to total link."""
    return -(-percent * total // (100 + percent))


class CountTree:
    """A bulk-loaded R-tree over count vectors. Boxes keep upper corners, sizes and whether one component holds all."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, component: np.ndarray, percent: int = PERCENT):
        # tiles by component, then size, then the coordinate that varies most
        lead = points[:, np.argmax(points.var(0))] if len(points) else np.zeros(0)
        self.percent = percent
        self.order = np.lexsort((lead, sizes, component))
        self.points, self.sizes, self.component = points[self.order], sizes[self.order], component[self.order]
        self.levels = []
        high, low_n, high_n, low_c, high_c = self.points, self.sizes, self.sizes, self.component, self.component
        while True:
            at = np.arange(0, len(high), FAN)
            high, low_n, high_n = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)
            low_c, high_c = np.minimum.reduceat(low_c, at), np.maximum.reduceat(high_c, at)
            self.levels.append((high, low_n, high_n, low_c, high_c))
            if len(high) == 1:
                break

    def _open(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of boxes (level -1: points) may hold a link between two components."""
        high, low_n, high_n, low_c, high_c = self.levels[level] if level >= 0 else (self.points, self.sizes, self.sizes, self.component, self.component)
        ok = (100 * high_n[a] >= self.percent * low_n[b]) & (100 * high_n[b] >= self.percent * low_n[a])
        ok &= ~((low_c[a] == high_c[a]) & (low_c[b] == high_c[b]) & (low_c[a] == low_c[b]))
        at = np.flatnonzero(ok)
        for lo in range(0, len(at), 8192):
            some = at[lo : lo + 8192]
            ok[some] = np.minimum(high[a[some]], high[b[some]]).sum(1, dtype=np.int64) >= least_overlap(low_n[a[some]] + low_n[b[some]], self.percent)
        return ok

    def chunks(self):
        """Arrays of pairs of rows (as given), shape (k, 2), that may link across components: all of them, in chunks of bounded size."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            ok = self._open(level, a, b)
            a, b = a[ok], b[ok]
            if level < 0:
                if len(a):
                    yield np.stack([self.order[a], self.order[b]], 1)
                continue
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            step = np.arange(FAN)
            for lo in range(0, len(a), 256):  # bounded work space
                x = (a[lo : lo + 256, None, None] * FAN + step[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
                y = (b[lo : lo + 256, None, None] * FAN + step[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
                fine = (x < below) & (y < below) & ((x < y) if level == 0 else (x <= y))
                if fine.any():
                    stack.append((level - 1, x[fine], y[fine]))

    def pairs(self) -> np.ndarray:
        """All pairs of chunks()."""
        return np.concatenate([np.zeros((0, 2), np.int64), *self.chunks()])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that edges (a, b) connect it with."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def lesser_keys(key: int, held: pa.ListArray) -> np.ndarray:
    """A row of bits per document for the keys below `key` that two of them hold: if two rows have a bit in common, a lesser
    key is shared, and its tree looks at the pair."""
    at = np.repeat(np.arange(len(held)), np.diff(np.asarray(held.offsets)))
    values = np.asarray(held.flatten())
    below = values < key
    _, code, count = np.unique(values[below], return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    some = count[code] > 1
    bits = np.zeros((len(held), int((count > 1).sum())), bool)
    bits[at[below][some], shared[code[some]]] = True
    return np.packbits(bits, axis=1)


def common_bits(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b of bits have one in common, in bounded work space."""
    step = max(1, (1 << 22) // max(1, bits.shape[1]))
    parts = [(bits[a[lo : lo + step]] & bits[b[lo : lo + step]]).any(1) for lo in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


class Forests:
    """Up to `layers` spanning forests of candidates over the components of a tree; `whole` is false once a pair fits in none."""

    def __init__(self, component: np.ndarray, layers: int):
        self.component, self.layers, self.whole = component, layers, True
        self.size = int(component.max(initial=-1)) + 1
        self.root: list[np.ndarray] = []
        self.found: list[np.ndarray] = []

    def add(self, pairs: np.ndarray) -> None:
        """Each layer takes the pairs that connect what it has not connected yet, and leaves the others to the next."""
        for k in range(self.layers):
            if not len(pairs):
                return
            if k == len(self.root):
                self.root.append(np.arange(self.size))
            x, y = self.component[pairs[:, 0]], self.component[pairs[:, 1]]
            root, rest, taken = self.root[k], np.arange(len(pairs)), np.zeros(len(pairs), bool)
            while True:
                u, v = root[x[rest]], root[y[rest]]
                apart = u != v
                rest, u, v = rest[apart], u[apart], v[apart]
                if not len(rest):
                    break
                # every part takes its first pair: as no two pairs are equally early, these close no circle
                first = np.full(self.size, len(rest))
                np.minimum.at(first, u, np.arange(len(rest)))
                np.minimum.at(first, v, np.arange(len(rest)))
                some = np.unique(first[first < len(rest)])
                taken[rest[some]] = True
                root = roots(u[some], v[some], self.size)[root]
            self.root[k] = root
            self.found.append(pairs[taken])
            pairs = pairs[~taken]
        self.whole = self.whole and not len(pairs)

    def pairs(self) -> np.ndarray:
        return np.concatenate([np.zeros((0, 2), np.int64), *self.found])


def linked(a: bytes, b: bytes, percent: int = PERCENT) -> bool:
    """Whether two stored sets link, exactly."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _node(g: np.ndarray) -> int:
    return int(_mix(g, 11).sum().view(np.int64)) if len(g) else 0


_DESCRIBED = pa.schema([("n", pa.int64()), ("node", pa.int64()), ("point", pa.binary())])
_KEYED = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _first_in_task(rows: list, shingle: int):
    """For each row (id as text, text) its set and node, and whether it has an id and is the first of this id and set in the task."""
    task = TaskContext.get()
    attempt = task.taskAttemptId() if task else -1
    if attempt not in _seen:
        _seen.clear()  # a worker runs one task at a time
    seen = _seen.setdefault(attempt, set())
    for row in rows:
        g = shingles(row["text"], shingle)
        node = _node(g)
        first = len(g) > 0 and row["id"] is not None and (row["id"], node) not in seen
        if first:
            seen.add((row["id"], node))
        yield g, node, first


def _describe(rows: list, shingle: int) -> list:
    """Size, node and (of first rows) point."""
    return list(zip(*((len(g), node, point(g) if first else None) for g, node, first in _first_in_task(rows, shingle)))) or [[]] * 3


def _keyed(rows: list, shingle: int, percent: int) -> list:
    """Node and (of first rows) keys. Keys are many times a text's other traits: they are made where they are shuffled, and never kept."""
    return list(zip(*((node, group_keys(g, percent) if first else None) for g, node, first in _first_in_task(rows, shingle)))) or [[]] * 2


_SET = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])


class Texts:
    """Token sets by node, made again from the texts of those nodes that are asked for."""

    def __init__(self, named: DataFrame, sets: DataFrame, shingle: int, percent: int):
        """named: (id, text); sets: (node, first), first the least id of the set."""
        self.named, self.sets, self.shingle, self.percent = named, sets, shingle, percent

    def tokens(self, nodes: DataFrame) -> DataFrame:
        """(node, tokens) of nodes (node)."""
        size = self.shingle

        def made(texts: list) -> list:
            sets = [shingles(t, size) for t in texts]
            return [[_node(g) for g in sets], [g.astype("<u8").tobytes() for g in sets]]

        nodes = small(keep(nodes.distinct()))
        ids = small(keep(self.sets.join(nodes, "node").select(F.col("first").alias("id")).distinct()))
        got = self.named.join(ids, "id", "left_semi").select(over_texts(made, _SET)(F.col("text")).alias("s")).select("s.*")
        # an id may have other texts, too
        return keep(got.join(nodes, "node", "left_semi").dropDuplicates(["node"]))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), which are written, those that link by their token sets."""
        sets, percent = self.tokens(pairs.select(F.explode(F.array("a", "b")).alias("node"))), self.percent
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")

        def call(ta: pa.Array, tb: pa.Array) -> pa.Array:
            return pa.array([linked(x, y, percent) for x, y in zip(ta.to_pylist(), tb.to_pylist())], pa.bool_())

        call.__annotations__ = {"ta": pa.Array, "tb": pa.Array, "return": pa.Array}
        return keep(both.withColumn("ok", F.arrow_udf(call, "boolean").asNondeterministic()("ta", "tb")).filter("ok").select("a", "b"))


def _contracted(edges: DataFrame, named: bool = False) -> DataFrame:
    """Edges (a, b) as stars (the least node of what a task connects, each other node of it): at most as many, with the
    same components. named: each least node comes with itself, too."""

    def call(batches):
        t = [x for x in batches if x.num_rows]
        if not t:
            return
        t = pa.Table.from_batches(t)
        node, code = np.unique(np.concatenate([t.column("a").to_numpy(), t.column("b").to_numpy()]), return_inverse=True)
        root = roots(code[: t.num_rows], code[t.num_rows :], len(node))
        rest = np.arange(len(node)) if named else np.flatnonzero(root != np.arange(len(node)))
        for lo in range(0, len(rest), 50_000):
            some = rest[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(node[root[some]]), pa.array(node[some])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(call, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), which are written: component is the least node.

    Each task contracts up to EDGES edges to stars. Where that leaves more than one task holds, large and small stars
    alternate until edges no longer change."""
    n = edges.count()
    if n > EDGES:
        edges = keep(_contracted(edges.repartition(-(-n // EDGES))))
        n = edges.count()
    if n <= EDGES:
        star = _contracted(edges.coalesce(1), named=True)
    else:
        star = _stars(edges)
        star = star.unionByName(star.select("a", F.col("a").alias("b")).distinct())
    return keep(star.select(F.col("b").alias("node"), F.col("a").alias("component")))


def _stars(edges: DataFrame) -> DataFrame:
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    last = None
    while True:
        edges = keep(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0]
        if now == last or not now[0]:
            return edges
        last = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct())
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(low, "b")
        edges = met.select(F.col("m").alias("a"), "b").unionByName(met.filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


_FOUND = "key long, i long, j long, a long, b long"


def _search(rows: DataFrame, layers: int, percent: int) -> DataFrame:
    """Candidate pairs of nodes, from rows (key, i, j, tile, node, n, point, component, keys): a tree per (key, i, j), which
    pairs rows of tile i with rows of tile j. A row with null a and b says that the tree had more than its layers hold."""

    def groups(batches):
        """Whole groups, from batches sorted by group."""
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            if not t.num_rows:
                continue
            k = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            edges = [0, *cut.tolist()]
            for lo, hi in zip(edges, edges[1:]):
                yield t.slice(lo, hi - lo)
            held = t.slice(edges[-1])
        if held is not None and held.num_rows:
            yield held

    def call(batches):
        for t in groups(batches):
            node, n, tile = (t.column(c).to_numpy() for c in ("node", "n", "tile"))
            _, comp = np.unique(t.column("component").to_numpy(), return_inverse=True)
            if comp.max() == 0:
                continue
            key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
            bits, forests = None, Forests(comp, layers)
            for found in CountTree(fold(t.column("point").to_pylist()), n, comp, percent).chunks():
                if i != j:
                    found = found[tile[found[:, 0]] != tile[found[:, 1]]]
                if bits is None:
                    bits = lesser_keys(key, pa.concat_arrays(t.column("keys").chunks))
                forests.add(found[~common_bits(bits, found[:, 0], found[:, 1])])
            found = forests.pairs()
            a, b = node[found[:, 0]], node[found[:, 1]]
            low, high = np.minimum(a, b).tolist(), np.maximum(a, b).tolist()
            if not forests.whole:
                low, high = [*low, None], [*high, None]
            for lo in range(0, len(low), 50_000):
                x, y = pa.array(low[lo : lo + 50_000], pa.int64()), pa.array(high[lo : lo + 50_000], pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(x), v, np.int64)) for v in (key, i, j)), x, y], names=["key", "i", "j", "a", "b"])

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(call, _FOUND)


def _tiled(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (key, node, component, ...) with i, j and tile: a key of hot (key) is cut into tiles, and its rows come once per pair of
    tiles that is to be searched. A component of more than TILE rows has tiles of its own, which are not paired with
    each other; all other components share tiles."""
    plain = rows.join(hot, "key", "left_anti").withColumns({c: F.lit(0).cast("long") for c in ("i", "j", "tile")})
    if hot.isEmpty():
        return plain
    rows = rows.join(hot, "key")
    size = rows.groupBy("key", "component").count()
    size = size.withColumn("rest", F.sum(F.when(F.col("count") <= TILE, F.col("count")).otherwise(0)).over(W.partitionBy("key")))
    size = keep(size.select("key", "component", (F.col("count") > TILE).alias("large"), F.ceil(F.col("count") / TILE).alias("parts"), F.ceil(F.greatest("rest", F.lit(1)) / TILE).alias("shared")))
    own = F.xxhash64(F.lit("own"), "component", F.pmod(F.xxhash64("node"), F.col("parts")))
    tile = F.when(F.col("large"), own).otherwise(F.pmod(F.xxhash64("component"), F.col("shared")))
    rows = keep(rows.join(size, ["key", "component"]).withColumn("tile", tile).drop("parts", "shared"))
    tiles = keep(rows.select("key", "tile", F.when(F.col("large"), F.col("component")).alias("of")).distinct())
    pairs = tiles.select("key", F.col("tile").alias("i"), F.col("of").alias("x")).join(tiles.select("key", F.col("tile").alias("j"), F.col("of").alias("y")), "key")
    pairs = keep(pairs.filter((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).select("key", "i", "j"))
    sides = pairs.withColumn("tile", F.col("i")).unionByName(pairs.filter("i <> j").withColumn("tile", F.col("j")))
    return plain.unionByName(rows.drop("large").join(sides, ["key", "tile"]), allowMissingColumns=False)


def _met(keys: DataFrame, drawn: DataFrame) -> DataFrame:
    """(node, key, rep, often) of the keys (key, node) that two nodes share; rep is the least node of the key, or of its
    part. drawn: keys of one document in SAMPLE.

    A window over each key finds them, in one pass. Keys that the sample shows to be met often are cut into PARTS first, so
    that none of their rows waits for all others; a part may be one node. Which way a key goes loses no row."""
    hot = keep(drawn.groupBy("key").count().filter(F.col("count") >= OFTEN).select("key", F.lit(True).alias("often")))
    keys = keys.join(small(hot), "key", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    keys = keys.withColumn("part", F.when(F.col("often"), F.pmod(F.xxhash64("node"), F.lit(PARTS))).otherwise(0).cast("byte"))
    w = W.partitionBy("key", "part")  # one column, so that both windows share a shuffle
    met = keys.withColumn("rep", F.min("node").over(w)).withColumn("top", F.max("node").over(w))
    return met.filter("rep < top or often").select("node", "key", "rep", "often")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs: id, n_shingles, component (the least id reachable by links). percent: from 67 to 100."""
    if not 67 <= percent <= 100 or shingle < 1:
        raise ValueError("percent must lie between 67 and 100, shingle be 1 or more")
    named = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    row = F.struct(F.col("id").cast("string").alias("id"), "text")
    d = keep(named.select("id", over_texts(lambda rows: _describe(rows, shingle), _DESCRIBED)(row).alias("d")).select("id", "d.*"))
    have = d.filter("n > 0 and id is not null")
    sets = keep(have.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    # the least id of sets that several rows have; all other rows are the first of theirs
    many = small(keep(sets.filter("copies > 1").select("node", "first")))
    texts = Texts(named, sets, shingle, percent)

    def first(rows: DataFrame) -> DataFrame:
        return rows.join(many, "node", "left").filter("first is null or first = id")

    rep = first(have.filter("point is not null")).select("node", "n", "point")
    keyed = over_texts(lambda rows: _keyed(rows, shingle, percent), _KEYED)(row)

    def keys(rows: DataFrame) -> DataFrame:
        return first(rows.select("id", keyed.alias("k")).select("id", "k.*").filter("keys is not null")).select("node", F.explode("keys").alias("key"))

    # an id of several sets connects them
    of = have.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a < top").select("id", "a")
    links = keep(have.join(small(keep(of)), "id").filter("a <> node").select("a", F.col("node").alias("b")).distinct())
    drawn = keys(named.filter(F.pmod(F.xxhash64(F.lit("hot keys"), F.col("id").cast("string")), F.lit(SAMPLE)) == 0))
    met = keep(_met(keys(named), drawn))
    tidy(docs.sparkSession)
    star = met.filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    reps = met.filter("often").select("key", "rep").distinct()  # the parts of a key that is met often meet, too
    least = reps.groupBy("key").agg(F.min("rep").alias("a"))
    star = keep(star.unionByName(reps.join(least, "key").filter("a <> rep").select("a", F.col("rep").alias("b"))).distinct())
    tested = star
    links = keep(links.unionByName(texts.verified(_bounded(star, rep, percent))))
    comp = components(links)
    tidy(docs.sparkSession)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(small(comp), "node", "left").withColumn("component", F.coalesce("component", "node"))

    # keys whose documents are in several components still; of keys with the same documents one stays
    met = met.select("key", "node")
    g = placed(met).groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("same"))
    one = keep(g.filter("low < high").groupBy("size", "same").agg(F.min("key").alias("key")))
    hot = small(keep(one.filter(F.col("size") > TILE).select("key")))
    held = met.join(small(one.select("key")), "key").groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")).withColumn("least", F.slice("keys", 1, LEAST))
    members = keep(held.join(rep.select("node", "n", "point"), "node").dropDuplicates(["node"]))
    tidy(docs.sparkSession)
    layers, again = LAYERS, None
    while not members.isEmpty():
        rows = placed(members).withColumn("key", F.explode("keys")).drop("keys").withColumnRenamed("least", "keys")
        if again is not None:
            rows = rows.join(again, "key", "left_semi")
        found = keep(_search(_tiled(rows, hot), layers, percent))
        tidy(docs.sparkSession)
        pairs = keep(found.filter("a is not null").select("a", "b").distinct().join(small(tested), ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            links = keep(links.unionByName(texts.verified(pairs)))
            tested = keep(tested.unionByName(pairs))
            comp = components(links)
        again = keep(found.filter("a is null").select("key").distinct())
        if again.isEmpty():
            break
        again, layers = small(again), layers * MORE
    return _result(d, sets, many, comp)


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and the sum of the smaller coordinates let link."""
    nodes = small(keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
    points = keep(points.select("node", "n", "point").join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    both = pairs.join(points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb")), "b").join(points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa")), "a")
    both = both.filter((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))

    def may(pa_: pa.Array, pb_: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        out = []
        for x, y, m, n in zip(pa_.to_pylist(), pb_.to_pylist(), na.to_pylist(), nb.to_pylist()):
            p = fold([x, y])
            out.append(bool(np.minimum(p[0], p[1]).sum(dtype=np.int64) >= least_overlap(m + n, percent)))
        return pa.array(out, pa.bool_())

    may.__annotations__ = {"pa_": pa.Array, "pb_": pa.Array, "na": pa.Array, "nb": pa.Array, "return": pa.Array}
    return keep(both.withColumn("may", F.arrow_udf(may, "boolean").asNondeterministic()("pa", "pb", "na", "nb")).filter("may").select("a", "b"))


def _result(d: DataFrame, sets: DataFrame, many: DataFrame, comp: DataFrame) -> DataFrame:
    """Components are named by their least id; most nodes are linked with none, and their rows need no look-up."""
    of = keep(sets.select("node", "first").join(small(comp), "node"))
    name = of.groupBy("component").agg(F.min("first").alias("name"))
    linked_ = small(keep(of.select("node", "component").join(small(keep(name)), "component").select("node", "name")))
    out = d.select("id", "n", "node").join(linked_, "node", "left").join(many, "node", "left")
    found = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("name", "first", "id")).otherwise(F.col("id")))
    return out.select("id", F.col("n").alias("n_shingles"), found.alias("component"))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: the one of the least id. Of rows with this id, one of the least hash of the
    text stays. Rows without an id are documents each, and all stay."""
    got = keep(join(docs, key, text, shingle, percent))
    names = [F.col(f"`{c}`") for c in docs.columns]
    gone_id, least = fresh(docs, "gone_id"), fresh(docs, "least_hash")
    gone = got.filter("id <> component").select(F.col("id").alias(gone_id)).distinct()
    out = docs.join(small(keep(gone)), F.col(f"`{key}`") == F.col(gone_id), "left_anti")
    # rows of one id: only those ids meet in a shuffle
    twice = got.filter("id is not null").groupBy("id").count().filter("count > 1").select(F.col("id").alias(gone_id))
    twice = small(keep(twice))
    once = out.join(twice, F.col(f"`{key}`") == F.col(gone_id), "left_anti")
    again = out.join(twice, F.col(f"`{key}`") == F.col(gone_id), "left_semi")
    again = again.withColumn(least, F.xxhash64(F.col(f"`{text}`"))).groupBy(F.col(f"`{key}`").alias(gone_id)).agg(F.min_by(F.struct(*names), least).alias("row")).select("row.*")
    return once.unionByName(again) if not twice.isEmpty() else once


def op9(docs: DataFrame) -> DataFrame:
    shingle, percent = OP9
    return join(docs, "doc_id", "text", shingle, percent).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))

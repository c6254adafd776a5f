"""Packing documents into sequences: shortest-pack-first over the length histogram.

Texts become token ids, documents are cut into pieces of at most the capacity (whole capacities first, then the rest),
and only the histogram of piece lengths reaches the driver: at most `capacity` counts, whatever the corpus. Lengths are
placed from the longest down, each into the pattern of packs with the most room, and counts of equal packs move together.
The patterns then meet the pieces again by rank: the k-th piece of a length belongs to one place of one pattern.

Cases: a null or empty text is one piece with the end id only; equal texts are packed one by one; repeated rows (same
doc_id) get pieces each; an empty table has no sequence.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep, over_texts
from .ranks import ranked

CAPACITY, END = 2048, 1
#: Characters on which both implementations of the byte-level vocabulary surely agree; other texts take the slower one.
_plain = re.compile(r"[^\t\n\x20-\x7e\xa1-\u024f]")
_encoders: dict = {}


class Encoder:
    """Ids as the tokenizer file gives them, without special tokens added.

    A tokenizer file of the byte-level kind is a vocabulary with merge ranks, which `tiktoken` applies several times
    faster than `tokenizers` does; the ranks are taken from the file itself. Texts with special tokens' strings, control
    characters, unusual white space or characters beyond Latin go through `tokenizers`. Tests compare the two.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"] for t in file["added_tokens"]]
        # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in k): v for k, v in file["model"]["vocab"].items() if k not in self.special}
        self.fast = tiktoken.Encoding("from_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by `tokenizers`, loaded when a text first needs it."""
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            if _plain.search(t) or any(s in t for s in self.special):
                rest.append(k)
            elif t:
                out[k] = np.array(self.fast.encode_ordinary(t), "<u4").tobytes()
        for k, ids in zip(rest, self.whole([texts[k] for k in rest]) if rest else []):
            out[k] = ids
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces (start, length) of a document of total ids."""
    return [(s, min(capacity, total - s)) for s in range(0, total, capacity)]


def pieces(df: DataFrame, key: str, text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, payload: str = "ids") -> DataFrame:
    """A row per piece: key, start, length, doc_tokens, and the piece's ids (payload="ids": array; "crc32": their checksum)."""
    path = path or tokenizer_path()
    kind = pa.list_(pa.int32()) if payload == "ids" else pa.int64()
    piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), (payload, kind)])
    last = np.array([end], "<u4").tobytes()

    def call(texts: list) -> list:
        rows, totals, lo = [], [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 1_000_000):  # bounded work space, whatever the texts' lengths
                size += len(texts[hi] or "")
                hi += 1
            for ids in encoder(path).encode([t or "" for t in texts[lo:hi]]):
                ids += last
                total = len(ids) // 4
                totals.append(total)
                rows.append([{"start": s, "length": n, payload: zlib.crc32(ids[4 * s : 4 * (s + n)]) if payload == "crc32" else np.frombuffer(ids, "<u4")[s : s + n].astype(np.int32)} for s, n in cut(total, capacity)])
            lo = hi
        return [rows, totals]

    schema = pa.schema([("pieces", pa.list_(piece)), ("doc_tokens", pa.int64())])
    done = df.select(F.col(key), over_texts(call, schema)(F.col(text)).alias("p"))
    return done.select(key, F.col("p.doc_tokens").alias("doc_tokens"), F.explode("p.pieces").alias("piece")).select(key, "piece.start", "piece.length", f"piece.{payload}", "doc_tokens")


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how many packs, lengths in it) that hold every piece of the histogram (length to count)."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    most: list[int] = []  # rooms in use, the largest at the end
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while most and not room[most[-1]]:
                del room[most.pop()]
            if most and most[-1] >= length:
                free = most[-1]
                count, pattern = room[free].pop()
                taken = min(count, left)
                if taken < count:
                    room[free].append((count - taken, pattern))
            else:
                free, taken, pattern = capacity, left, ()
            left -= taken
            gap = free - length
            if gap not in room:
                bisect.insort(most, gap)
            room[gap].append((taken, (*pattern, length)))
    return [p for gap in sorted(room) for p in room[gap]]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Per length and range of ranks: the sequence of the range's first piece, and the offset in each sequence."""
    next_rank: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, next_rank[length], base, offset))
            next_rank[length] += count
            offset += length
        base += count
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(table: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (columns of `pieces`, written already) with sequence_id and offset; names that they have already get _1."""
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}
    at = places(shortest_pack_first(histogram, capacity))
    # a (length, rank) as one number, so that one search finds the range
    span = max(histogram.values(), default=0) + 1
    keys = at["length"] * span + at["rank"]

    def call(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        i = np.searchsorted(keys, n * span + r, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(at["sequence"][i] + r - at["rank"][i]), pa.array(at["offset"][i])], names=["sequence_id", "offset"])

    call.__annotations__ = {"length": pa.Array, "rank": pa.Array, "return": pa.Array}
    place = F.arrow_udf(call, "sequence_id long, offset long").asNondeterministic()
    rank, at_ = fresh(table, "rank_in_length"), fresh(table, "place")
    out = ranked(table, "length", [key, "start"], rank).withColumn(at_, place("length", rank))
    names = {c: fresh(table, c) for c in ("sequence_id", "offset")}
    return out.select(*[F.col(f"`{c}`") for c in table.columns], *[F.col(f"{at_}.{c}").alias(n) for c, n in names.items()])


def op6(docs: DataFrame) -> DataFrame:
    """The query: the operator with checksums of the ids in place of the ids."""
    table = keep(pieces(docs, "doc_id", payload="crc32"))
    return pack(table, "doc_id").select("doc_id", "start", "length", F.col("crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

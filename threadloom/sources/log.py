"""Message logs as JSON lines, chat headers, and the importer of chat exports.

A rewrite is written beside the log and takes its place once it is whole, so a rewrite that fails leaves the log as it was.
One folder per chat, named by its slug, so that many chats load in one scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHAT, MESSAGE


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Messages under path. Rows without id or date are an error when they are read."""
    m = spark.read.schema(MESSAGE).option("mode", "PERMISSIVE").json(path)
    whole = F.assert_true(F.col("id").isNotNull() & F.col("date").isNotNull(), "a message needs id and date").isNull()
    return m.filter(whole)


def append_log(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").json(path)


def rewrite_log(messages: DataFrame, path: str) -> None:
    spark, path = messages.sparkSession, path.rstrip("/")
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    messages.write.json(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(old))
    if not fs.rename(hadoop(new), hadoop(path)):
        raise OSError(f"{new} is whole, but could not take the place of {path}")
    fs.delete(hadoop(old), True)


def reset_log(spark: SparkSession, path: str, media: str | None = None) -> None:
    """An empty log; its media folder goes, too."""
    rewrite_log(spark.createDataFrame([], MESSAGE), path)
    if media:
        folder = spark._jvm.org.apache.hadoop.fs.Path(media)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def profile(spark: SparkSession, paths: list[str | None], otherwise: str = "(no profile)") -> str:
    """The first of some small text files that exists."""
    for p in filter(None, paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return "\n".join(r[0] for r in spark.read.text(p, wholetext=True).collect()).strip()
    return otherwise


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHAT).option("multiLine", True).json(path)


def write_headers(chats: DataFrame, path: str) -> None:
    chats.write.mode("overwrite").json(path)


def list_chats(spark: SparkSession, root: str) -> DataFrame:
    """Folders under root that hold a meta.json, sorted."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "meta.json").option("recursiveFileLookup", True).load(root).select("path")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("slug")).distinct().orderBy("slug")


def digits(v):
    """The number in an id like user123; null where it has no digit."""
    return F.regexp_replace(v, r"\D", "").try_cast("bigint")


#: Chat kinds of an export; all others are groups. Media types that have another name here; all others keep theirs.
KINDS = {"personal_chat": "user", "private_channel": "channel", "public_channel": "channel"}
MEDIA = {"voice_message": "voice", "video_file": "video"}


def import_export(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Messages and chat header of a chat export: one JSON object with a list of messages of several shapes.

    lines: many exports, one per line."""
    doc = spark.read.format("json").option("singleVariantColumn", "v").option("multiLine", not lines).load(path)
    one = F.explode(F.variant_get("v", "$.messages", "array<variant>")).alias("m")
    raw = doc.select(one)

    def get(p: str, kind: str = "string"):
        return F.try_variant_get("m", p, kind)

    pieces = F.try_variant_get("m", "$.text", "array<variant>")
    text = F.when(F.schema_of_variant(F.try_variant_get("m", "$.text", "variant")).startswith("ARRAY"), F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit(""))), "")).otherwise(F.coalesce(get("$.text"), F.lit("")))
    mapped = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    photo = get("$.photo").isNotNull()
    messages = raw.filter(get("$.type") == "message").select(
        get("$.id", "bigint").alias("id"),
        get("$.date").alias("date"),
        digits(get("$.from_id")).alias("sender_id"),
        get("$.from").alias("sender_name"),
        text.alias("text"),
        get("$.reply_to_message_id", "bigint").alias("reply_to"),
        F.when(photo, "photo").otherwise(F.coalesce(F.try_element_at(mapped, get("$.media_type")), get("$.media_type"))).alias("media_type"),
        get("$.photo").alias("media_path"),
        get("$.media_type").alias("media_raw"),
    )
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    chat = doc.select(F.try_variant_get("v", "$.id", "bigint").alias("id"), F.try_variant_get("v", "$.name", "string").alias("title"), F.coalesce(F.try_element_at(kinds, F.try_variant_get("v", "$.type", "string")), F.lit("group")).alias("kind"))
    return messages, chat

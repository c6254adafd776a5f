"""What is shown of a message's media: placeholders for atoms, and a long form for days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X


def slots(kind: Column, desc: Column, filename: Column, resent: Column | None = None, failed: Column | None = None) -> Column:
    """A placeholder for what a message carries besides its text; resent, failed: about pictures without a description."""
    described = F.coalesce(desc, F.lit("")) != ""
    name = F.nullif(filename, F.lit(""))
    return (
        F.when(kind.isNull(), None)
        .when((kind == "photo") & described, F.concat(F.lit("[photo: "), desc, F.lit("]")))
        .when((kind == "photo") & F.coalesce(F.lit(False) if resent is None else resent, F.lit(False)), "[photo: re-sent image — vision unavailable]")
        .when((kind == "photo") & F.coalesce(F.lit(False) if failed is None else failed, F.lit(False)), "[photo: download failed — vision unavailable]")
        .when(kind == "photo", "[photo: vision unavailable]")
        .when(kind.isin("audio", "voice"), "[audio: transcription unavailable]")
        .when((kind == "video") & described, F.concat(F.lit("[video thumbnail: "), desc, F.lit("]")))
        .when(kind == "video", F.concat(F.lit("[file: "), F.coalesce(name, F.lit("video")), F.lit(" — thumbnail not described]")))
        .when(kind == "file", F.concat(F.lit("[file: "), F.coalesce(name, F.lit("file")), F.lit("]")))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )


def long_form(kind: Column, desc: Column, name: Column, emoji: Column, phone: Column, lat: Column, long: Column) -> Column:
    """The long form of what a message carries. A contact card shows a digest of its phone or name, never these."""
    seed = F.lower(F.trim(F.coalesce(F.nullif(phone, F.lit("")), name, F.lit(""))))
    file = F.nullif(name, F.lit(""))
    card = F.when(seed == "", "[contact]").otherwise(F.concat(F.lit("[contact: @u"), X.digest(F.concat(F.lit("contact:"), seed)), F.lit("]")))
    say = lambda what, value: F.concat(F.lit(f"[{what}: "), value, F.lit("]"))
    body = (
        F.when(kind.isNull(), None)
        .when((kind == "photo") & (F.coalesce(desc, F.lit("")) != ""), say("photo", desc))
        .when(kind == "photo", "[photo]")
        .when(kind == "sticker", say("sticker", F.coalesce(emoji, F.lit(""))))
        .when(kind.isin("audio", "voice"), F.concat(F.lit("["), kind, F.lit(": "), F.coalesce(file, kind), F.lit("]")))
        .when(kind.isin("video", "file"), F.concat(F.lit("["), kind, F.lit(": "), F.coalesce(file, kind), F.lit("]")))
        .when(kind == "contact", card)
        .when(kind == "geo", F.concat(F.lit("[location: "), lat.cast("string"), F.lit(", "), long.cast("string"), F.lit("]")))
        .otherwise(F.concat(F.lit("["), kind, F.lit("]")))
    )
    return F.concat(F.lit("  "), body)


def poll(question: Column, options: Column, total: Column, quiz: Column, closed: Column) -> Column:
    """A poll; options: array of struct(text, voters)."""
    top = F.concat(F.lit("  [poll"), F.when(quiz, " (quiz)").otherwise(""), F.lit(": "), F.coalesce(question, F.lit("")), F.lit("]"))
    rows = F.transform(options, lambda o: F.concat(F.lit("    - "), F.coalesce(o["text"], F.lit("")), F.when(o["voters"].isNotNull(), F.concat(F.lit(" — "), o["voters"].cast("string"), F.lit(" votes"))).otherwise("")))
    end = F.when(total.isNotNull(), F.array(F.concat(F.lit("    ("), total.cast("string"), F.lit(" total voters"), F.when(closed, ", closed").otherwise(""), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(top), rows, end), "\n")


def shown_of(kind: Column, desc: Column, meta: Column) -> Column:
    """The long form, from a message's media_meta."""

    def get(path: str, to: str = "string") -> Column:
        return F.try_variant_get(meta, path, to)

    options = F.transform(F.try_variant_get(meta, "$.options", "array<variant>"), lambda o: F.struct(F.try_variant_get(o, "$.text", "string").alias("text"), F.try_variant_get(o, "$.voters", "bigint").alias("voters")))
    yes = lambda p: F.coalesce(get(p, "boolean"), F.lit(False))
    ballot = poll(get("$.question"), F.coalesce(options, F.array().cast("array<struct<text:string,voters:bigint>>")), get("$.total_voters", "bigint"), yes("$.quiz"), yes("$.closed"))
    name = F.coalesce(get("$.filename"), get("$.title"), get("$.name"))
    return F.when(kind == "poll", ballot).otherwise(long_form(kind, desc, name, get("$.emoji"), get("$.phone"), get("$.lat"), get("$.long")))


def slots_of(kind: Column, desc: Column, meta: Column) -> Column:
    """The slots as an array, from a message's media_meta: what has no slot of its own shows its long form."""

    def get(path: str, to: str = "string") -> Column:
        return F.try_variant_get(meta, path, to)

    own = slots(kind, desc, get("$.filename"), get("$.resend", "boolean"), get("$.download_failed", "boolean"))
    one = F.when(kind.isin("photo", "audio", "voice", "video", "file"), own).otherwise(F.trim(shown_of(kind, desc, meta)))
    return F.when(F.coalesce(kind, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(one))

"""Identities: one row per person, and texts without names. Dictionaries are joined per message, not collected.

A message only needs the entries of the handles or numbers that occur in it: those are extracted, joined to the dictionary,
and folded back as a map per message, so dictionaries of any size work and nothing is broadcast unchecked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

#: The chat of messages that are all of one log.
LOG = "log_of_all"


def seen(messages: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """(per..., person, sender_id, name, handle, at, spoke): who sends a message, and the real people that it mentions."""
    m = messages if "sender_username" in messages.columns else messages.withColumn("sender_username", F.lit(None).cast("string"))
    out = m.select(*per, X.person_seed("sender_id", "sender_name").alias("person"), "sender_id", F.col("sender_name").alias("name"), F.col("sender_username").alias("handle"), F.struct("date", "id", F.lit(0).alias("place")).alias("at"), F.lit(1).alias("spoke"))
    if "mentions" in messages.columns:
        each = messages.select(*per, "date", "id", F.posexplode("mentions").alias("place", "x")).filter("x.real and x.user_id is not null")
        out = out.unionByName(each.select(*per, X.person_seed("x.user_id", "x.name").alias("person"), F.col("x.user_id").alias("sender_id"), "x.name", "x.handle", F.struct("date", "id", (F.col("place") + 1).alias("place")).alias("at"), F.lit(0).alias("spoke")))
    return out.withColumn("handle", F.nullif(F.regexp_replace("handle", "^@+", ""), F.lit("")))


def people(messages: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """A row per person (of each chat, by the columns per): person (what tells them apart), key, sender_id, names and
    usernames in order of first sight, whether an id stands behind it, and the number of messages. People who are only
    mentioned have rows, too. Keys are short: two people may share one, and still have a row each."""
    s = seen(messages, per)
    said = F.explode(F.array(F.struct(F.lit("name").alias("what"), F.nullif(F.col("name"), F.lit("")).alias("value"), F.col("spoke").alias("n")), F.struct(F.lit("handle").alias("what"), F.col("handle").alias("value"), F.lit(0).alias("n"))))
    one = s.select(*per, "person", "sender_id", "at", said.alias("x")).groupBy(*per, "person", "x.what", "x.value").agg(F.min("at").alias("at"), F.min("sender_id").alias("sid"), F.sum("x.n").alias("n"))

    def listed(what: str) -> Column:
        mine = F.collect_list(F.when((F.col("what") == what) & F.col("value").isNotNull(), F.struct("at", "value")))
        return F.transform(F.array_sort(mine), lambda v: v["value"])

    out = one.groupBy(*per, "person").agg(F.min("sid").alias("sender_id"), listed("name").alias("names"), listed("handle").alias("usernames"), F.min("sid").isNotNull().alias("grounded"), F.sum("n").alias("n_messages"))
    return out.select(*per, "person", X.key_of("person").alias("key"), "sender_id", "names", "usernames", "grounded", "n_messages")


def handles(messages: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """(per..., handle, key) of known people; of a handle that changed hands, the last holder."""
    s = seen(messages, per).filter("handle is not null")
    last = s.groupBy(*per, F.lower("handle").alias("handle")).agg(F.max_by("person", "at").alias("person"))
    return last.select(*per, "handle", X.key_of("person").alias("key"))


def strangers(messages: DataFrame, known: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """(key, handle) of handles in texts that belong to nobody known; of two spellings, the one that comes first."""
    said = messages.select(*per, "date", "id", F.explode(F.regexp_extract_all("text", F.lit(X.MENTION), F.lit(1))).alias("said")).withColumn("handle", F.lower("said"))
    said = said.filter(~F.col("handle").isin(*X.GROUP_TOKENS)).join(known, [*per, "handle"], "left_anti")
    first = said.groupBy("handle").agg(F.min_by("said", F.struct("date", "id")).alias("said"))
    return first.select(X.mention_key(F.col("handle")).alias("key"), F.col("said").alias("handle"))


def _base() -> Column:
    """A readable handle from the first name."""
    slug = F.regexp_replace(F.lower(F.trim(F.coalesce(F.get("names", F.lit(0)), F.lit("")))), r"(?U)\W+", "")
    return F.when(slug == "", F.col("key")).otherwise(F.concat(F.lit("@"), slug))


def _label(*order: str) -> Column:
    """Of rows of one base, the first by order is called by it, the others by it and a part of their key."""
    w = W.partitionBy("base").orderBy(*order)
    return F.when(F.row_number().over(w) == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.substring("key", 3, 4)))


def labels(persons: DataFrame) -> DataFrame:
    """key and a readable handle from the first name; a second one of the same gets a part of its key. People of one key have
    a row for each of their first names."""
    p = persons.select("key", _base().alias("base")).distinct()
    return p.select("key", _label("key").alias("label"))


def lookups(messages: DataFrame, pattern: str, group: int, table: DataFrame, key: str, value: str, lower: bool = False) -> DataFrame:
    """Messages with a map column `found` of what the matches of pattern in their text mean by the table."""
    hit = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))))
    hits = messages.select("id", hit.alias("hit"))
    on = F.lower("hit") if lower else F.col("hit").try_cast(dict(table.dtypes)[key])
    one = table.groupBy(F.col(key).alias("k")).agg(F.max(value).alias("v"))  # a map holds a key once
    met = hits.join(one, on == F.col("k"))
    maps = met.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("k", "v"))).alias("found")).withColumnRenamed("id", "of")
    empty = F.map_from_arrays(F.array().cast(f"array<{dict(table.dtypes)[key]}>"), F.array().cast("array<string>"))
    return messages.join(maps, F.col("id") == F.col("of"), "left").drop("of").withColumn("found", F.coalesce("found", empty))


def sanitised(messages: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """text without handles and ids, with @me and @all as the people that they mean; slots (if there is such a column: an
    array of texts) without handles and ids, too. per: the columns that tell chats apart; people are known by chat.

    Handles and numbers are looked up together: each message meets what it says, not the dictionary. Texts without any keep
    out of the joins, and only texts that address all meet the roster."""
    chat = list(per) or [LOG]
    m = messages if per else messages.withColumn(LOG, F.lit(0))
    persons = people(m, chat)
    known = persons.filter("sender_id is not null").select(*chat, F.concat(F.lit("i:"), F.col("sender_id").cast("string")).alias("token"), "key")
    known = known.unionByName(handles(m, chat).select(*chat, F.concat(F.lit("h:"), "handle").alias("token"), "key"))
    slots = "slots" in messages.columns
    loose = F.concat_ws("\n", "text", F.array_join("slots", "\n")) if slots else F.coalesce("text", F.lit(""))
    tokens = F.concat(
        F.transform(F.regexp_extract_all(loose, F.lit(X.MENTION), F.lit(1)), lambda h: F.concat(F.lit("h:"), F.lower(h))),
        F.transform(F.regexp_extract_all(loose, F.lit(X.NUMBER), F.lit(0)), lambda n: F.concat(F.lit("i:"), n)),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    some = m.filter(loose.rlike(r"(?U)@|\d"))
    hits = some.select(*chat, "id", F.explode(F.array_distinct(tokens)).alias("token"))
    maps = hits.join(known, [*chat, "token"]).groupBy(*chat, "id").agg(F.map_from_entries(F.collect_set(F.struct("token", "key"))).alias("found"))
    some = some.join(maps, [*chat, "id"], "left").withColumn("found", F.coalesce("found", empty))
    addressed = F.coalesce(F.col("text").rlike(X.ALL), F.lit(False))
    roster = persons.groupBy(*chat).agg(F.array_join(F.array_sort(F.collect_set("key")), " ").alias("everyone"))
    some = some.filter(addressed).join(roster, chat).unionByName(some.filter(~addressed).withColumn("everyone", F.lit("")))

    def clean(text: Column) -> Column:
        return X.scrub_ids(X.pseudonymise(text, F.col("found"), "h:"), F.col("found"), "i:")

    some = some.withColumn("text", X.expand_groups(clean(F.col("text")), F.col("everyone"), X.person_key("sender_id", "sender_name")))
    if slots:
        some = some.withColumn("slots", F.transform("slots", clean))
    out = m.filter(~F.coalesce(loose.rlike(r"(?U)@|\d"), F.lit(False))).unionByName(some.drop("found", "everyone"))
    return out.select(*messages.columns)


def humanised(texts: DataFrame, label: DataFrame) -> DataFrame:
    """Keys in texts (id, text) as readable labels; unknown keys stay."""
    t = lookups(texts, r"@u[0-9a-f]{8}", 0, label, "key", "label", lower=True)
    return t.withColumn("text", X.rewrite(F.col("text"), r"@u[0-9a-f]{8}", 0, lambda _, w: F.coalesce(F.try_element_at(F.col("found"), w), w))).drop("found")


def vault(persons: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """Key, label and what stands behind it, for restricted storage; handles of strangers have rows of their own. A key that
    several share has a row for each of them."""
    out = persons.withColumn("base", _base()).select("key", _label("key", "person").alias("label"), "sender_id", "names", "usernames", "grounded", F.lit(False).alias("mention_only"))
    if unknown is not None:
        at = F.concat(F.lit("@"), "handle")
        more = unknown.select("key", at.alias("label"), F.lit(None).cast("long").alias("sender_id"), F.array(at).alias("names"), F.array().cast("array<string>").alias("usernames"), F.lit(False).alias("grounded"), F.lit(True).alias("mention_only"))
        out = out.unionByName(more)
    return out.orderBy("key")


def readable(persons: DataFrame, unknown: DataFrame) -> DataFrame:
    """(key, label) of people, and of strangers by the handle that they were called."""
    more = unknown.join(persons.select("key"), "key", "left_anti")
    return labels(persons).unionByName(more.select("key", F.concat(F.lit("@"), "handle").alias("label")))

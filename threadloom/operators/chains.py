"""Reply chains: parents, roots, atoms and their groups.

Roots come from pointer jumping: every round each message looks past its pointer's pointer, so a chain of length n needs
log2(n) rounds of one join each. Each round is written to the shared checkpoint folder, so plans stay flat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import media
from .lineage import cut

GENERIC = ("chat", "channel")


def source(extra: Column | None = None) -> Column:
    """Where a message comes from, as a label: what `extra` names as its source, or what kind of place it stands in."""
    c = F.col
    named = F.lit(None).cast("string") if extra is None else F.nullif(F.try_variant_get(extra, "$.source", "string"), F.lit(""))
    return F.when(named.isNotNull(), named).when(c("post_id").isNotNull(), "channel").when(c("topic_id").isNotNull(), F.concat(F.lit("chat/topic:"), c("topic_id").cast("string"))).otherwise("chat")


def is_named(s: Column) -> Column:
    return (s != "") & ~s.isin(*GENERIC) & ~s.startswith("chat/topic:")


def kind() -> Column:
    return F.when(F.col("post_id").isNull(), "message").when(F.col("post_id") == F.col("id"), "post").otherwise("comment")


def with_parent(messages: DataFrame) -> DataFrame:
    """Each message with its parent's id where the parent is in the log (duplicates of an id count once)."""
    ids = messages.select(F.col("id").alias("parent_id")).distinct()
    return messages.join(ids, F.col("reply_to") == F.col("parent_id"), "left")


def _settle(jump: DataFrame) -> tuple[DataFrame, int, int]:
    """Pointers (id, to, top) jumped until all rest on a top, or until a round settles nothing new: what is left then leads
    into cycles. With the number left, and the steps that each of their pointers has gone."""
    left, span = None, 1
    while True:
        nxt = jump.select(F.col("id").alias("j"), F.col("to").alias("j_to"), F.col("top").alias("j_top"))
        # null j: the parent is not in the log
        joined = jump.join(nxt, F.col("to") == F.col("j"), "left")
        jump = cut(joined.select("id", F.coalesce(F.when(~F.col("top"), F.col("j_to")), F.col("to")).alias("to"), (F.col("top") | F.coalesce("j_top", F.lit(True))).alias("top")))
        last, left, span = left, jump.filter(~F.col("top")).count(), 2 * span
        if not left or left == last:
            return jump, left, span


def roots(messages: DataFrame) -> DataFrame:
    """(id, root): a post's own id for what belongs to it, else the top of the reply chain; a lost parent is the root.

    On a cycle, pointers never come to rest: a member is its own root, and a tail has the first member on its way.
    Duplicated ids follow their first reply_to by value."""
    one = messages.groupBy("id").agg(F.min("reply_to").alias("reply_to"), F.min("post_id").alias("post_id"))
    up = one.withColumn("to", F.coalesce("post_id", "reply_to", "id")).withColumn("done", F.col("post_id").isNotNull() | F.col("reply_to").isNull())
    # a pointer rests when what it points at is a top, a post's member counts by its own reply_to on the way of others
    base = one.select("id", F.coalesce("reply_to", "id").alias("to"), F.col("reply_to").isNull().alias("top"))
    jump, left, span = _settle(base)
    found = jump.filter("top").select("id", F.col("to").alias("root"))
    if left:
        ring = jump.filter(~F.col("top")).select("id", "to")
        rest = base.join(ring.select("id"), "id", "left_semi")
        # pointers that have gone as many steps as messages are left have passed every tail, and reach each cycle's members
        while span < left:
            ring = cut(ring.join(ring.select(F.col("id").alias("j"), F.col("to").alias("j_to")), F.col("to") == F.col("j")).select("id", F.col("j_to").alias("to")))
            span *= 2
        on = ring.select(F.col("to").alias("member")).distinct()
        ends = rest.join(on, F.col("id") == F.col("member"), "left").select("id", F.coalesce("member", "to").alias("to"), F.col("member").isNotNull().alias("top"))
        found = found.unionByName(_settle(cut(ends))[0].select("id", F.col("to").alias("root")))
    return up.select("id", F.when(F.col("done"), F.col("to")).alias("own")).join(found, "id", "left").select("id", F.coalesce("own", "root").alias("root"))


def with_root(messages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Messages with their root. links: the same messages before costly columns were made of them, for the chains alone."""
    found = roots(messages if links is None else links)
    return messages.join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).drop("of")


#: What an atom keeps of its members; the last four only where messages have them (see `described`).
MEMBER, MORE = ("date", "id", "sender_id", "sender_name", "text"), ("who", "slots", "told", "media_type")


def described(messages: DataFrame) -> DataFrame:
    """Messages with who (the sender's key), source, slots (what is shown of media) and told (keys of real people mentioned)."""
    c, has = F.col, set(messages.columns)
    extra = c("extra") if "extra" in has else None
    meta = c("media_meta") if "media_meta" in has else F.parse_json(F.lit(None).cast("string"))
    told = F.array().cast("array<string>")
    if "mentions" in has:
        real = F.filter("mentions", lambda x: F.coalesce(x["real"], F.lit(False)) & x["user_id"].isNotNull())
        told = F.coalesce(F.transform(real, lambda x: X.person_key(x["user_id"], x["name"])), told)
    return messages.withColumns({"who": X.person_key("sender_id", "sender_name"), "source": source(extra), "slots": media.slots_of(c("media_type"), c("photo_desc") if "photo_desc" in has else F.lit(None).cast("string"), meta), "told": told})


def atoms(rooted: DataFrame) -> DataFrame:
    """A row per root: members in order of date and id (an id once), and what the last of them says of the whole."""
    names = [*MEMBER, *(c for c in MORE if c in rooted.columns)]
    members = F.array_sort(F.collect_list(F.struct(*names)))
    origin = F.col("source") if "source" in rooted.columns else source()
    a = rooted.groupBy("root").agg(members.alias("members"), F.max_by(origin, F.struct("date", "id")).alias("source"), F.array_sort(F.collect_set(kind())).alias("kinds"))
    a = a.withColumn("members", F.filter("members", lambda m, i: (i == 0) | (F.get("members", i - 1)["id"] != m["id"])))
    leaf = F.element_at("members", -1)
    a = a.withColumn("n_members", F.size("members").cast("long")).withColumn("leaf_id", leaf["id"]).withColumn("leaf_date", leaf["date"]).withColumn("sender", X.person_key(leaf["sender_id"], leaf["sender_name"]))
    if "told" in names:
        told = F.array_distinct(F.flatten(F.transform("members", lambda m: m["told"])))
        a = a.withColumn("mentions", F.filter(told, lambda k: k != F.col("sender")))
    return a


def by_person(atoms: DataFrame) -> DataFrame:
    """Atoms with the group that takes them in one pass: the last author's, and that of each person mentioned."""
    who = F.array(F.col("sender")) if "mentions" not in atoms.columns else F.array_union(F.array("sender"), "mentions")
    return atoms.withColumn("group", F.explode(who))


def by_day(messages: DataFrame) -> DataFrame:
    """Messages with the day of their post, or their own: a late comment stays with its post."""
    posts = messages.filter("id = post_id").groupBy(F.col("id").alias("p")).agg(F.max(X.day("date")).alias("post_day"))
    return messages.join(posts, F.col("post_id") == F.col("p"), "left").withColumn("day", F.coalesce("post_day", X.day("date"))).drop("p", "post_day")


def posts(messages: DataFrame) -> DataFrame:
    """A row per post: its comments' ids in order, and whether its own text is in the log."""
    ids = F.array_sort(F.collect_list("id"))
    return messages.filter("post_id is not null").groupBy("post_id").agg(F.filter(ids, lambda i: i != F.col("post_id")).alias("comments"), F.max(F.col("id") == F.col("post_id")).alias("present"))


def batches(costs: DataFrame, budget: int, chat: list[str] | None = None) -> DataFrame:
    """(chat..., seq, cost) with a batch number: atoms in order fill a batch until the next would go over budget.

    Where a batch starts depends on where the last one did, so each chat is one ordered walk over (seq, cost), streamed
    through a task in order; chats are walked in parallel. Without `chat`, everything is one chat."""
    keys = chat or []
    budget = max(1, budget)

    def walk(frames):
        import pandas as pd

        last, n, used = None, 0, 0
        for f in frames:
            out = []
            ks = list(zip(*[f[k] for k in keys])) if keys else [()] * len(f)
            for k, cost in zip(ks, f["cost"]):
                if k != last:
                    last, n, used = k, 0, 0
                elif used and used + cost > budget:
                    n, used = n + 1, 0
                used += cost
                out.append(n)
            yield f.assign(batch=pd.Series(out, index=f.index, dtype="int64"))

    dealt = costs.repartition(*keys).sortWithinPartitions(*keys, "seq") if keys else costs.coalesce(1).sortWithinPartitions("seq")
    return dealt.mapInPandas(walk, ", ".join(f"`{n}` {t}" for n, t in costs.dtypes) + ", batch long")

"""Registered queries over whole messages: people, sanitised texts, atoms and what they read like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chains, identity, media, rendering
from ..sources import adapters as A
from .queries import TOK, query

CHAT = ["chat"]


def told(spark, d) -> DataFrame:
    """Messages described and sanitised, by chat."""
    return identity.sanitised(chains.described(A.talk(spark, d)), CHAT)


def atoms(spark, d) -> DataFrame:
    return chains.atoms(chains.with_root(told(spark, d), A.conversations(spark, d)))


HEAD = "'[' || substr(date,12,5) || '] ' || who || ':' || CASE WHEN clean <> '' THEN ' ' || clean ELSE '' END"
CONTENT = f"""txt AS (SELECT root, chat, max(date) AS leaf_date, any_value(source) AS source, CASE WHEN chat % 3 = 0 THEN '[source: ' || any_value(source) || ']' || chr(10) ELSE '' END
 || string_agg({HEAD} || CASE WHEN slot IS NOT NULL THEN chr(10) || '  ' || slot ELSE '' END, chr(10) ORDER BY date, id) AS content FROM san GROUP BY root, chat)"""


@query("SELECT id, source FROM tlk", A.TALK)
def prj_source(spark, d):
    return chains.described(A.talk(spark, d)).select("id", "source")


@query("SELECT root, source, chat % 3 = 0 AS named FROM (SELECT DISTINCT root, source, chat FROM tlk)", A.TALK)
def flt_named(spark, d):
    a = chains.atoms(chains.with_root(chains.described(A.talk(spark, d))))
    return a.select("root", "source", chains.is_named(F.col("source")).alias("named"))


@query("SELECT chat, key, min(sender_id) AS sender_id, min(name) AS name, min(username) AS username FROM per GROUP BY chat, key", A.TALK)
def id_build(spark, d):
    p = identity.people(A.talk(spark, d), CHAT)
    return p.groupBy("chat", "key").agg(F.min("sender_id").alias("sender_id"), F.min(F.get("names", F.lit(0))).alias("name"), F.min(F.get("usernames", F.lit(0))).alias("username"))


@query("SELECT id, clean AS text, slot FROM san", A.TALK)
def id_sanitize(spark, d):
    return told(spark, d).select("id", "text", F.get("slots", F.lit(0)).alias("slot"))


VAULT = f"""vlt AS (SELECT key, sender_id, grounded, mention_only, username, CASE WHEN mention_only THEN base WHEN row_number() OVER (PARTITION BY mention_only, base ORDER BY key) = 1 THEN base ELSE base || '_' || substr(key, 3, 4) END AS label FROM (
 SELECT DISTINCT key, sender_id, true AS grounded, false AS mention_only, username, '@' || lower(replace(name, ' ', '')) AS base FROM per
 UNION SELECT DISTINCT {A._key("mention", "'guest' || turn % 3")}, NULL, false, true, NULL, '@Guest' || turn % 3 FROM tlk WHERE turn % 5 = 0
 UNION SELECT DISTINCT ukey, NULL, false, true, NULL, '@user' || chat FROM tlk JOIN rst USING (chat) WHERE turn % 5 = 0 AND NOT has_user))"""


def _vault(spark, d) -> tuple[DataFrame, DataFrame]:
    m = A.talk(spark, d)
    return identity.people(m), identity.strangers(m, identity.handles(m))


@query("SELECT key, label, sender_id, username, grounded, mention_only FROM vlt", A.TALK, VAULT)
def id_vault(spark, d):
    v = identity.vault(*_vault(spark, d))
    return v.select("key", "label", "sender_id", F.get("usernames", F.lit(0)).alias("username"), "grounded", "mention_only")


@query("SELECT id, 'by ' || v.label || ' to ' || coalesce(g.label, s.gkey) || ' and @u00000000' AS text FROM (SELECT *, " + A._key("mention", "'guest' || turn % 3") + " AS gkey FROM who) s JOIN vlt v ON v.key = s.who LEFT JOIN vlt g ON g.key = s.gkey", A.TALK, VAULT)
def id_humanize(spark, d):
    texts = A.talk(spark, d).select("id", F.concat(F.lit("by "), X.person_key("sender_id", "sender_name"), F.lit(" to "), X.mention_key(F.concat(F.lit("Guest"), ((F.col("id") % 1000) % 3).cast("string"))), F.lit(" and @u00000000")).alias("text"))
    return identity.humanised(texts, identity.readable(*_vault(spark, d))).select("id", "text")


@query("SELECT root, CASE WHEN bool_or(turn % 4 = 1) THEN any_value(silent) END AS mentions FROM who GROUP BY root", A.TALK)
def atoms_mentions(spark, d):
    a = chains.atoms(chains.with_root(chains.described(A.talk(spark, d))))
    return a.select("root", F.when(F.size("mentions") > 0, F.array_join("mentions", ",")).alias("mentions"))


@query('SELECT "group", CAST(count(DISTINCT root) AS BIGINT) AS atoms FROM (SELECT root, last_value(who) OVER (PARTITION BY root ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS "group" FROM who UNION ALL SELECT root, silent FROM who WHERE turn % 4 = 1) GROUP BY 1', A.TALK)
def grp_people(spark, d):
    a = chains.atoms(chains.with_root(chains.described(A.talk(spark, d))))
    return chains.by_person(a).groupBy("group").agg(F.count("*").alias("atoms"))


@query(f"SELECT root, n_members, sender, n_slots FROM (SELECT root, CAST(count(*) AS BIGINT) AS n_members, arg_max(who, id) AS sender, CAST(count(slot) AS BIGINT) AS n_slots FROM san GROUP BY root)", A.TALK)
def atoms_members(spark, d):
    slots = F.aggregate("members", F.lit(0).cast("long"), lambda n, m: n + F.size(m["slots"]))
    return atoms(spark, d).select("root", "n_members", "sender", slots.alias("n_slots"))


@query(f"SELECT id, {HEAD} || CASE WHEN turn % 12 = 6 THEN ' ' || chr(10) || '  [photo]' WHEN turn % 6 = 1 THEN ' ' || chr(10) || '  [file: ' || 'f ' || ukey || ']' WHEN slot IS NOT NULL THEN ' ' || chr(10) || '  ' || slot ELSE '' END AS line FROM san", A.TALK)
def rnd_message(spark, d):
    return _shown(spark, d).select("id", rendering.line(F.col("date"), F.col("who"), F.col("text"), F.col("shown")).alias("line"))


def _shown(spark, d) -> DataFrame:
    """Messages with the long form of their media, sanitised."""
    m = chains.described(A.talk(spark, d))
    shown = media.shown_of(F.col("media_type"), F.col("photo_desc"), F.col("media_meta"))
    m = m.withColumn("slots", F.when(shown.isNull(), F.array().cast("array<string>")).otherwise(F.array(shown)))
    return identity.sanitised(m, CHAT).withColumn("shown", F.get("slots", F.lit(0)))


@query("SELECT root, content FROM txt", A.TALK, CONTENT)
def rnd_atom(spark, d):
    return rendering.atom_text(atoms(spark, d)).select("root", "content")


@query(f"SELECT root, CAST({TOK.format('content')} AS BIGINT) AS tokens FROM txt", A.TALK, CONTENT)
def tok_atom(spark, d):
    return rendering.atom_text(atoms(spark, d)).select("root", X.tokens("content").alias("tokens"))


DAY_LINE = "'[' || substr(e.date,12,5) || '] @u' || left(sha256('id:' || e.sender_id), 8) || ': ' || e.text || CASE e.media_type WHEN 'photo' THEN ' ' || chr(10) || '  [photo]' WHEN 'video' THEN ' ' || chr(10) || '  [video: video]' WHEN 'file' THEN ' ' || chr(10) || '  [file: file]' ELSE '' END"


@query(
    f"""SELECT day, '## ' || day || chr(10) || string_agg(part, chr(10) ORDER BY post_id, lead DESC, id) AS content FROM (
 SELECT coalesce(substr(p.date,1,10), substr(e.date,1,10)) AS day, e.post_id, e.id = e.post_id AS lead, e.id, CASE WHEN e.id = e.post_id THEN '▸ POST — ' ELSE '    ↳ ' END || {DAY_LINE} AS part
 FROM evt e LEFT JOIN evt p ON p.id = e.post_id AND p.post_id = p.id) GROUP BY day""",
    A.EVENTS,
)
def rnd_day(spark, d):
    m = A.events(spark, d)
    shown = media.shown_of(F.col("media_type"), F.lit(None).cast("string"), F.parse_json(F.lit(None).cast("string")))
    return rendering.days(m.withColumn("shown", shown)).select("day", "content")


@query(f"SELECT day, '## ' || day || chr(10) || string_agg({HEAD}, chr(10) ORDER BY date, id) AS content FROM (SELECT *, substr(date,1,10) AS day FROM san) GROUP BY day", A.TALK)
def rnd_day_plain(spark, d):
    return rendering.days(told(spark, d)).select("day", "content")


@query(
    """SELECT chat, batch, CAST(count(*) AS BIGINT) AS atoms, CAST(sum(cost) AS BIGINT) AS tokens, min(seq) AS first_seq FROM pck GROUP BY chat, batch""",
    A.TALK,
    CONTENT,
    f"tkn AS (SELECT root // 1000 % 7 AS chat, root, row_number() OVER (PARTITION BY root // 1000 % 7 ORDER BY leaf_date, root) AS seq, {TOK.format('content')} AS cost FROM txt)",
    """pck AS (SELECT chat, seq, cost, cost AS used, CAST(0 AS BIGINT) AS batch FROM tkn WHERE seq = 1
 UNION ALL SELECT t.chat, t.seq, t.cost, CASE WHEN p.used + t.cost > 4000 THEN t.cost ELSE p.used + t.cost END, p.batch + CASE WHEN p.used + t.cost > 4000 THEN 1 ELSE 0 END FROM tkn t JOIN pck p ON t.chat = p.chat AND t.seq = p.seq + 1)""",
)
def pack(spark, d):
    """Report-ready batches: messages to chains to sanitised atoms to tokens to batches."""
    from .report import batched

    return batched(A.talk(spark, d), F.floor(F.col("root") / 1000) % 7, 4000, CHAT)

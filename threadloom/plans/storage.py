"""Registered queries over JSON-lines logs, headers, chat exports, reports and checkpoints: what is written is read again.

Each writes to a new path in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chains, lineage
from ..sources import adapters as A
from ..sources import log
from . import run, writer
from .queries import CONV_ROOTS, query

COLS = ("id", "date", "sender_id", "sender_name", "text", "reply_to")
TLK = "SELECT id, date, sender_id, role AS sender_name, text || CASE turn % 5 WHEN 0 THEN ' cc @user' || chat || ' and @Guest' || turn % 3 WHEN 1 THEN ' see ' || (900000000000 + chat*10 + 1) || ' or 0' || (900000000000 + chat*10 + 1) WHEN 2 THEN ' @all, from @me' ELSE ' mail a@b.org' END AS text, CASE WHEN turn > 0 THEN id - 1 END AS reply_to FROM tlk"


def _log(spark, d) -> str:
    path = lineage.folder(spark)
    log.append_log(A.talk(spark, d).drop("chat"), path)
    return path


@query(TLK + " ORDER BY id", A.TALK)
def src_load(spark, d):
    return log.read_log(spark, _log(spark, d)).select(*COLS)


@query("SELECT id, CASE WHEN turn % 4 = 1 THEN 'Silent' || chat END AS handle, CASE WHEN turn % 6 = 1 THEN 'f @user' || chat END AS filename, CASE WHEN chat % 3 = 0 THEN 'proj' || chat % 5 END AS source FROM tlk", A.TALK)
def src_jsonl(spark, d):
    """Nested and variant columns survive the log."""
    m = log.read_log(spark, _log(spark, d))
    return m.select("id", F.get("mentions", F.lit(0))["handle"].alias("handle"), F.try_variant_get("media_meta", "$.filename", "string").alias("filename"), F.try_variant_get("extra", "$.source", "string").alias("source"))


@query("SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM conv", A.CONVERSATIONS)
def snk_append(spark, d):
    path, m = lineage.folder(spark), A.conversations(spark, d)
    log.append_log(m, path)
    log.append_log(m.filter("id % 3 = 0"), path)
    return log.read_log(spark, path).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT id, sender_name FROM conv WHERE id % 2 = 0", A.CONVERSATIONS)
def snk_rewrite(spark, d):
    path = lineage.folder(spark)
    log.append_log(A.conversations(spark, d), path)
    log.rewrite_log(log.read_log(spark, path).filter("id % 2 = 0"), path)
    return log.read_log(spark, path).select("id", "sender_name")


@query("SELECT CAST(0 AS BIGINT) AS n")
def snk_reset(spark, d):
    path = _log(spark, d)
    log.reset_log(spark, path)
    return log.read_log(spark, path).agg(F.count("*").alias("n"))


HEADS = "SELECT 's' || n_nationkey AS slug, n_nationkey AS id, n_name AS title, CASE WHEN n_regionkey = 1 THEN 'channel' ELSE 'group' END AS kind FROM nation"


def _heads(spark, d) -> DataFrame:
    n = A.read(spark, d, "nation")
    return n.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), F.when(F.col("n_regionkey") == 1, "channel").otherwise("group").alias("kind"))


def _chats(spark, d) -> str:
    """A folder per chat, with its header."""
    root = lineage.folder(spark)
    body = F.to_json(F.struct("slug", "id", "title", "kind")).alias("value")
    _heads(spark, d).select("slug", body).write.partitionBy("slug").text(root)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for chat in fs.listStatus(fs_path(root)):
        if chat.isDirectory():
            for part in fs.listStatus(chat.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), fs_path(chat.getPath(), "meta.json"))
            fs.rename(chat.getPath(), fs_path(root, chat.getPath().getName().partition("=")[2]))
    return root


@query(HEADS)
def snk_meta(spark, d):
    path = lineage.folder(spark)
    log.write_headers(_heads(spark, d), path)
    return spark.read.json(path).select("slug", "id", "title", "kind")


@query(HEADS)
def src_meta(spark, d):
    return log.read_headers(spark, f"{_chats(spark, d)}/*/meta.json").select("slug", "id", "title", "kind")


@query("SELECT 's' || n_nationkey AS slug FROM nation")
def src_list(spark, d):
    return log.list_chats(spark, _chats(spark, d))


def _export(spark, d) -> tuple[DataFrame, DataFrame]:
    """Conversations as one chat export; texts as a string or as pieces, ids with a prefix."""
    c = A.conversations(spark, d)
    turn = F.col("id") % 1000
    text = F.when(turn % 2 == 0, F.to_json(F.struct(F.array("text").alias("t"))).substr(F.lit(7), F.length(F.to_json(F.struct(F.array("text").alias("t")))) - 8))
    pieces = F.to_json(F.array(F.struct(F.lit("plain").alias("type"), F.col("text")), F.struct(F.lit("bold").alias("type"), F.lit("!").alias("text"))))
    quote = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    fields = [
        F.concat(F.lit('"type":'), F.when(turn % 5 == 4, quote(F.lit("service"))).otherwise(quote(F.lit("message")))),
        F.concat(F.lit('"id":'), F.col("id").cast("string")),
        F.concat(F.lit('"date":'), quote("date")),
        F.concat(F.lit('"from":'), quote("sender_name")),
        F.concat(F.lit('"from_id":'), F.when(turn % 3 == 2, quote(F.lit("channel"))).otherwise(quote(F.concat(F.lit("user"), F.col("sender_id").cast("string"))))),
        F.concat(F.lit('"text":'), F.coalesce(text, pieces)),
        F.concat(F.lit('"reply_to_message_id":'), F.col("reply_to").cast("string")),
        F.when(turn % 4 == 1, '"media_type":"voice_message"').when(turn % 4 == 2, '"photo":"p.jpg"'),
    ]
    one = c.select((F.col("id") / 1000).cast("long").alias("chat"), F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("m"))
    docs = one.groupBy("chat").agg(F.concat(F.lit('{"type":"'), F.when(F.col("chat") % 2 == 0, "public_channel").otherwise("private_group"), F.lit('","id":'), F.col("chat").cast("string"), F.lit(',"name":"C","messages":['), F.array_join(F.collect_list("m"), ","), F.lit("]}")).alias("value"))
    path = lineage.folder(spark)
    docs.select("value").write.text(path)
    return log.import_export(spark, path, lines=True)


@query("SELECT id, date, sender_name, reply_to, CASE (id % 1000) % 4 WHEN 1 THEN 'voice' WHEN 2 THEN 'photo' END AS media_type FROM conv WHERE (id % 1000) % 5 <> 4", A.CONVERSATIONS)
def imp_export(spark, d):
    return _export(spark, d)[0].select("id", "date", "sender_name", "reply_to", "media_type")


@query("SELECT DISTINCT id // 1000 AS id, 'C' AS title, CASE WHEN id // 1000 % 2 = 0 THEN 'channel' ELSE 'group' END AS kind FROM conv", A.CONVERSATIONS)
def imp_header(spark, d):
    return _export(spark, d)[1]


@query("SELECT id, CASE WHEN (id % 1000) % 3 <> 2 THEN sender_id END AS sender_id FROM conv WHERE (id % 1000) % 5 <> 4", A.CONVERSATIONS)
def imp_fromid(spark, d):
    return _export(spark, d)[0].select("id", "sender_id")


@query("SELECT id, text || CASE WHEN (id % 1000) % 2 = 0 THEN '' ELSE '!' END AS text FROM conv WHERE (id % 1000) % 5 <> 4", A.CONVERSATIONS)
def imp_text(spark, d):
    return _export(spark, d)[0].select("id", "text")


def _done(spark, d) -> DataFrame:
    a = chains.atoms(chains.with_root(A.conversations(spark, d)))
    return a.select(F.lit("people").alias("section"), "root", F.col("n_members").alias("done_count"), F.col("leaf_date").alias("done_leaf"))


@query("SELECT 'people' AS section, root, CAST(count(*) AS BIGINT) AS done_count, max(date) AS done_leaf FROM crt GROUP BY root", A.CONVERSATIONS, CONV_ROOTS)
def ck_persist(spark, d):
    state = run.State(spark, lineage.folder(spark))
    t = _done(spark, d)
    state.save(done=t, files=t.limit(0), tasks=t.limit(0), fired=t.limit(0))
    return state.load("done")


@query("SELECT 'people' AS section, root, CAST(count(*) AS BIGINT) AS done_count, max(date) AS done_leaf FROM crt WHERE root % 2000 = 0 GROUP BY root", A.CONVERSATIONS, CONV_ROOTS)
def ck_resume(spark, d):
    """The last whole version counts; one that was broken off, and one of another format, do not."""
    state = run.State(spark, lineage.folder(spark))
    t = _done(spark, d)
    none = t.limit(0)
    state.save(done=t, files=none, tasks=none, fired=none)
    state.save(done=t.filter("root % 2000 = 0"), files=none, tasks=none, fired=none)
    t.limit(1).write.parquet(f"{state.path}/3/done")
    return state.load("done")


@query("SELECT p_partkey AS id, upper(p_name) AS photo_desc FROM part")
def vis_describe(spark, d):
    """Each picture is described once, whoever posts it."""
    p = A.read(spark, d, "part")
    m = p.select(F.col("p_partkey").alias("id"), F.lit("photo").alias("media_type"), F.col("p_name").alias("media_path"), F.lit(None).cast("string").alias("photo_desc"))
    images = m.select("media_path", F.col("media_path").alias("prompt")).distinct()
    return writer.describe(m, images, str.upper).select("id", "photo_desc")


@query("SELECT p_partkey AS key, 'said ' || p_brand AS reply, false AS too_long FROM part")
def llm_run(spark, d):
    p = A.read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit("x: said "), "p_brand").alias("prompt"))
    return writer.write(p).select("key", "reply", "too_long")


@query('SELECT "group", section, CAST(count(*) AS BIGINT) AS atoms FROM (SELECT root, substr(max(date), 1, 10) AS "group", \'history\' AS section FROM crt GROUP BY root UNION ALL SELECT root, \'world\', \'world\' FROM crt GROUP BY root) GROUP BY 1, 2', A.CONVERSATIONS, CONV_ROOTS)
def grp_default(spark, d):
    from . import sections

    a = chains.atoms(chains.with_root(A.conversations(spark, d)))
    out = [s.groups(a).groupBy("group").agg(F.count("*").alias("atoms")).withColumn("section", F.lit(s.name)) for s in sections.build({"history": {}, "world": {}})]
    return out[0].unionByName(out[1])

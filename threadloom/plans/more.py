"""Further registered queries: views, sources, guards, triggers and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import text as X
from ..operators import chains, history, media, progress, store, views
from ..sources import adapters as A
from .queries import CONV_ROOTS, LIVE, TASKS, _tasks, query


@query("SELECT key FROM rec WHERE contains(lower(segment), 'build') AND total < 50000 AND status = 'F'", A.RECORDS)
def flt_where(spark, d):
    return store.query(A.records(spark, d), "", {"segment": "build", "total": "<50000", "status": ["F"]}, limit=None).select("key")


@query("SELECT '@u' || left(sha256('id:' || sender_id), 8) AS key, '@u' || left(sha256('mention:@' || sender_id), 8) AS mention FROM conv GROUP BY sender_id", A.CONVERSATIONS)
def id_label(spark, d):
    m = A.conversations(spark, d).select("sender_id").distinct()
    return m.select(X.person_key("sender_id", F.lit(None)).alias("key"), X.mention_key(F.concat(F.lit("@"), F.col("sender_id").cast("string"))).alias("mention"))


@query("SELECT root, CAST(count(*) AS BIGINT) AS n FROM crt GROUP BY root", A.CONVERSATIONS, CONV_ROOTS)
def grp_offers(spark, d):
    return chains.with_root(A.conversations(spark, d)).groupBy("root").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS place, text FROM (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS text FROM (SELECT doc_id, string_split(replace(body, '. ', chr(10) || chr(10)), chr(10) || chr(10)) AS p FROM fil)) WHERE trim(text) <> ''", A.FILES)
def vw_facts(spark, d):
    f = A.files(spark, d).select("doc_id", F.replace("body", F.lit(". "), F.lit("\n\n")).alias("body"))
    from pyspark.sql import Window as W

    return views.paragraphs(f).withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("position")).cast("long")).select("doc_id", "place", "text")


@query(
    """SELECT key, '- **' || CASE WHEN status = 'O' THEN segment ELSE coalesce(nullif(status || ' ' || segment, ''), '?') END || '** @ ' || key || ' — ' || CASE WHEN total > 100000 THEN '~$' || CAST(CAST(round_even(total / 1000, 0) AS BIGINT) AS VARCHAR) || 'k/yr' ELSE 'comp n/a' END
 || ' — ' || posted || CASE WHEN status = 'F' THEN ' — closed' ELSE '' END || CASE WHEN priority = '1-URGENT' THEN ' — [1-URGENT]' ELSE '' END AS text FROM rec""",
    A.RECORDS,
)
def rnd_offer(spark, d):
    r = A.records(spark, d)
    c = F.col
    text = views.offer(F.when(c("status") == "O", "unknown").otherwise(c("status")), c("segment"), c("key"), c("key"), F.when(c("total") > 100000, c("total")), F.lit(None).cast("double"), F.lit("unknown"), c("posted"), F.when(c("status") == "F", "closed").otherwise("open"), F.when(c("priority") == "1-URGENT", c("priority")).otherwise("routine"))
    return r.select("key", text.alias("text"))


@query("SELECT root % 11 AS batch, max(day) AS day FROM (SELECT root, max(substr(date,1,10)) AS day FROM crt GROUP BY root) GROUP BY 1", A.CONVERSATIONS, CONV_ROOTS)
def agg_batchday(spark, d):
    a = chains.atoms(chains.with_root(A.conversations(spark, d)))
    return a.groupBy((F.col("root") % 11).alias("batch")).agg(F.max(X.day("leaf_date")).alias("day"))


@query("SELECT key FROM rec ORDER BY key LIMIT 20", A.RECORDS)
def q_limit(spark, d):
    return store.query(A.records(spark, d)).select("key")


@query("SELECT DISTINCT d, CAST(year(CAST(d AS DATE)) - CASE WHEN month(CAST(d AS DATE)) = 1 THEN 1 ELSE 0 END AS BIGINT) AS y, CASE WHEN month(CAST(d AS DATE)) BETWEEN 2 AND 7 THEN 0 ELSE 1 END AS season FROM dys", A.HISTORY)
def dt_termorder(spark, d):
    days = A.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    t = P.term("d")
    return days.select("d", F.substring(t, 1, 4).cast("long").alias("y"), F.when(t.endswith("spring"), 0).otherwise(1).alias("season"))


@query("SELECT d, max(x) AS boundary FROM dys, (SELECT CAST(y AS VARCHAR) || m AS x FROM range(1994, 2003) t(y), (VALUES ('-12-01'), ('-05-01')) v(m)) WHERE x > '1996-03-01' AND x <= d GROUP BY d", A.HISTORY)
def trg_deadline(spark, d):
    days = A.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    hit = P.crossed(F.lit("1996-03-01"), F.greatest(F.col("d"), F.lit("1996-03-01")), ["12-01", "05-01"])
    return days.select("d", F.array_max(hit).alias("boundary")).filter("boundary is not null")


@query(
    """SELECT id, '  ' || CASE k WHEN 0 THEN '[photo: d' || id || ']' WHEN 1 THEN '[sticker: :)]' WHEN 2 THEN '[voice: voice]' WHEN 3 THEN '[file: f' || id || ']' WHEN 4 THEN '[contact: @u' || left(sha256('contact:+' || id), 8) || ']'
 WHEN 5 THEN '[location: ' || id || ', 7]' ELSE '[poll]' END AS text FROM (SELECT p_partkey AS id, p_partkey % 7 AS k FROM part)"""
)
def rnd_media(spark, d):
    p = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7).alias("k"))
    kinds = F.array(*[F.lit(k) for k in ("photo", "sticker", "voice", "file", "contact", "geo", "poll")])
    i = F.col("id").cast("string")
    text = media.long_form(F.get(kinds, F.col("k").cast("int")), F.concat(F.lit("d"), i), F.when(F.col("k") == 3, F.concat(F.lit("f"), i)), F.lit(":)"), F.concat(F.lit("+"), i), F.col("id"), F.lit(7))
    return p.select("id", text.alias("text"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || chr(10) || 'OCR:' || chr(10) || n_regionkey ELSE '[image 00] ' || n_name || chr(10) || chr(10) || '[image 01] b' || chr(10) || 'OCR:' || chr(10) || 'x' END AS text FROM nation")
def rnd_vision(spark, d):
    from ..operators import rendering

    n = A.read(spark, d, "nation")
    pair = lambda a, b: F.struct(a.alias("what"), b.alias("text"))
    parts = F.when(F.col("n_nationkey") % 2 == 0, F.array(pair(F.col("n_name"), F.col("n_regionkey").cast("string")))).otherwise(F.array(pair(F.col("n_name"), F.lit(" ")), pair(F.lit("b"), F.lit("x"))))
    return n.select(F.col("n_nationkey").alias("id"), rendering.pictures(parts).alias("text"))


@query(
    """SELECT key, array_to_string(list_filter([CASE WHEN balance IS NULL THEN 'balance: missing' END, CASE WHEN segment NOT IN ('AUTOMOBILE', 'BUILDING') THEN 'segment: not one of 2 values: ' || segment END, CASE WHEN total < 20000 THEN 'total: below 20000' END], lambda x: x IS NOT NULL), '; ') AS errors FROM rec""",
    A.RECORDS,
)
def st_errors(spark, d):
    from ..operators import records as R

    fields = [R.Field("balance", "double", required=True), R.Field("segment", "string", values=("AUTOMOBILE", "BUILDING")), R.Field("total", "double", least=20000)]
    return A.records(spark, d).select("key", F.array_join(R.errors(fields), "; ").alias("errors"))


@query("SELECT key, CASE WHEN status = 'P' THEN 'P' ELSE 'X' END AS status, total FROM rec", A.RECORDS)
def st_validate(spark, d):
    from ..operators import records as R

    r = A.records(spark, d).select("key", "status", "total")
    given = r.select("key", F.when(F.col("status") == "P", "bad").otherwise("X").alias("status"), F.lit(None).cast("double").alias("total"))
    return R.patch(r, given, [R.Field("status", "string", values=("X", "O", "F", "P")), R.Field("total", "double")]).select("key", "status", "total")



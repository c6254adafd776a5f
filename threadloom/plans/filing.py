"""Registered queries over files: guarded operations, views, triggers, the task queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budget, chains, history, lineage, store, views
from ..sources import adapters as A
from . import sections, triggers
from .queries import COSTS, LIVE, TASKS, TOK, _fill, _tasks, query
from .report import assembled, title_of, view_cost

# ------------------------------------------------------------------ guarded operations


def _ops(spark, d) -> tuple[DataFrame, DataFrame]:
    """Order lines as operations of a run on the files of their order; a third of the files are there before it."""
    log = A.op_log(spark, d)
    k, n = F.col("key"), F.col("seq") % 6
    name = F.when(k % 5 == 0, "facts.json").when(k % 7 == 0, "nowhere.txt").otherwise("notes.md")
    path = F.concat(F.lit(" companies//o"), k.cast("string"), F.lit("/"), name)
    op = F.when(n == 1, F.when(k % 4 == 0, "read").otherwise("touch")).when(n == 2, "write").when(n == 3, "append").when(n == 4, "edit").when(n == 5, "patch").otherwise("read")
    ops = log.select(path.alias("path"), k.alias("nr"), "seq", op.alias("op"), (F.col("quantity") > 25).alias("overwrite"), F.lit(1).alias("fields"), F.when(F.col("quantity") > 10, "x").alias("old"), "chat_time")
    held = log.select("key").distinct().filter("key % 3 = 0").select(F.concat(F.lit("companies/o"), k.cast("string"), F.lit("/"), name).alias("key"), F.concat(F.lit("body "), k.cast("string")).alias("body"), k.alias("nr"))
    prompt = F.when(F.col("nr") % 6 == 0, F.concat(F.lit("the view: body "), F.col("nr").cast("string"), F.lit(" and more"))).otherwise("the view")
    return ops, store.shown(held, prompt)


OPS = """ops AS (SELECT *, seq % 6 AS n, key % 5 = 0 AS typed, key % 5 <> 0 AND key % 7 = 0 AS bad, key % 3 = 0 AS held, key % 6 = 0 AS shown,
 CASE seq % 6 WHEN 1 THEN CASE WHEN key % 4 = 0 THEN 'read' ELSE 'touch' END WHEN 2 THEN 'write' WHEN 3 THEN 'append' WHEN 4 THEN 'edit' WHEN 5 THEN 'patch' ELSE 'read' END AS act FROM opl),
 his AS (SELECT *, coalesce(max(CASE WHEN act IN ('touch', 'write', 'append') THEN 1 ELSE 0 END) OVER w, 0) AS made, coalesce(max(CASE WHEN act = 'read' THEN 1 ELSE 0 END) OVER w, 0) AS looked FROM ops WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 vdt AS (SELECT key, seq, act, chat_time, bad, typed, CASE WHEN bad THEN 'no section owns this path'
  WHEN typed AND act IN ('write', 'append', 'edit') THEN 'typed record: patch it' WHEN act = 'patch' AND NOT typed THEN 'prose: write, append or edit it'
  WHEN act = 'touch' AND (held OR made = 1) THEN 'exists' WHEN act = 'write' AND (held OR made = 1) AND quantity <= 25 THEN 'exists' WHEN act = 'edit' AND NOT held AND made = 0 THEN 'does not exist'
  WHEN act IN ('write', 'append', 'edit') AND (held OR made = 1) AND NOT (shown OR looked = 1 OR (NOT held AND made = 1)) THEN 'unseen: read it first'
  WHEN act = 'edit' AND quantity <= 10 THEN 'nothing to replace' END AS error FROM his)"""


def _verdicts(spark, d) -> DataFrame:
    return store.checked(*_ops(spark, d))


@query("SELECT key AS nr, seq, act AS op, error FROM vdt", A.OP_LOG, OPS)
def st_guards(spark, d):
    return _verdicts(spark, d).select("nr", "seq", "op", "error")


@query("SELECT key AS nr, seq, error FROM vdt WHERE act = 'touch'", A.OP_LOG, OPS)
def st_touch(spark, d):
    return _verdicts(spark, d).filter("op = 'touch'").select("nr", "seq", "error")


@query("SELECT key AS nr, seq, coalesce(error LIKE 'typed%' OR error LIKE 'prose%', false) AS refused FROM vdt", A.OP_LOG, OPS)
def st_typed_guard(spark, d):
    return _verdicts(spark, d).select("nr", "seq", F.coalesce(F.col("error").startswith("typed") | F.col("error").startswith("prose"), F.lit(False)).alias("refused"))


@query("SELECT key AS nr, seq FROM vdt WHERE error LIKE 'unseen%'", A.OP_LOG, OPS)
def st_seen(spark, d):
    return _verdicts(spark, d).filter("error like 'unseen%'").select("nr", "seq")


@query("SELECT 'companies/o' || key || CASE WHEN typed THEN '/facts.json' ELSE '/notes.md' END AS key, max(chat_time) AS last_updated FROM vdt WHERE error IS NULL AND act <> 'read' GROUP BY key, typed", A.OP_LOG, OPS)
def st_meta(spark, d):
    return store.last_updated(_verdicts(spark, d).filter("error is null and op <> 'read'"))


@query("SELECT DISTINCT key AS nr, CASE WHEN NOT bad THEN CASE WHEN held THEN 'body ' || key ELSE '' END END AS body FROM ops", A.OP_LOG, OPS)
def st_read(spark, d):
    ops, files = _ops(spark, d)
    return store.read(ops.select("nr", "path").distinct(), files.select("key", "body")).select("nr", "body")


@query("SELECT path FROM fil WHERE path LIKE 'de/src1/%' ORDER BY path", A.FILES)
def st_list(spark, d):
    return store.listed(A.files(spark, d), "de/src1/", "path")


@query("SELECT key, string_agg(body, chr(10) || chr(10) ORDER BY seq) AS body FROM (SELECT *, max(seq) FILTER (op IN ('write', 'delete')) OVER (PARTITION BY key) AS r FROM (SELECT key, seq, body, CASE WHEN op = 'patch' AND quantity < 20 THEN 'delete' ELSE op END AS op FROM opl)) WHERE op IN ('write', 'append') AND (r IS NULL OR seq >= r) GROUP BY key", A.OP_LOG)
def st_delete(spark, d):
    log = A.op_log(spark, d)
    return store.bodies(log.withColumn("op", F.when((F.col("op") == "patch") & (F.col("quantity") < 20), "delete").otherwise(F.col("op"))))


@query("SELECT key, year FROM (SELECT key, CAST(substr(posted, 1, 4) AS INTEGER) AS year FROM rec) WHERE year = 1996", A.RECORDS)
def q_eq(spark, d):
    r = A.records(spark, d).select("key", F.substring("posted", 1, 4).cast("int").alias("year"))
    return store.query(r, where={"year": 1996}, limit=None)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def prj_dot(spark, d):
    return A.read(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def flt_service(spark, d):
    return A.read(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("""SELECT root, list_contains(kinds, 'post') AS entry FROM (SELECT post_id AS root, list(CASE WHEN post_id = id THEN 'post' ELSE 'comment' END) AS kinds FROM evt GROUP BY post_id)""", A.EVENTS)
def flt_entry(spark, d):
    posts = sections.Section("market", kinds=("post",))
    return chains.atoms(chains.with_root(A.events(spark, d))).select("root", posts.accepts(F.col("kinds")).alias("entry"))


@query("SELECT id FROM evt WHERE media_type IN ('photo', 'video') AND id % 5 <> 0", A.EVENTS)
def flt_photo_todo(spark, d):
    from . import writer

    m = A.events(spark, d).withColumns({"media_path": F.col("id").cast("string"), "photo_desc": F.when(F.col("id") % 5 == 0, "seen")})
    return writer.undescribed(m).select("id")


@query(f"SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'chat') AS slug FROM documents")
def slugify(spark, d):
    return A.read(spark, d, "documents").select("doc_id", X.slugify("text").alias("slug"))


# ------------------------------------------------------------------ views


def _files(df: DataFrame, path, body, updated) -> DataFrame:
    return df.select(path.alias("path"), body.alias("body"), updated.alias("updated"))


def _text(c) -> F:
    return F.col(c).cast("string")


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


@query(
    """SELECT 'contacts/c' || c_custkey || '.json' AS path, '- **' || CASE WHEN c_custkey % 9 = 0 THEN 'contacts/c' || c_custkey || '.json' ELSE '@c' || c_custkey END || '** (' || CASE WHEN c_custkey % 5 = 0 THEN '?' ELSE lower(c_mktsegment) END || '/' || CASE WHEN c_custkey % 2 = 0 THEN 'hr' ELSE 'unknown' END || ')'
 || CASE WHEN c_custkey % 3 = 0 THEN ' — n' || c_nationkey || ', x' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ' — 2 offer(s)' ELSE '' END AS text, CAST(c_custkey % 97 AS BIGINT) AS updated FROM customer"""
)
def vw_contacts(spark, d):
    k, n = F.col("c_custkey"), _text("c_custkey")
    body = _json(handle=F.when(k % 9 != 0, F.concat(F.lit("@c"), n)), kind=F.when(k % 5 != 0, F.lower("c_mktsegment")), role=F.when(k % 2 == 0, "hr"), companies=F.when(k % 3 == 0, F.array(F.concat(F.lit("n"), _text("c_nationkey")), F.lit("x"))), offers=F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"))))
    f = _files(A.read(spark, d, "customer"), F.concat(F.lit("contacts/c"), n, F.lit(".json")), body, (k % 97).cast("long"))
    return views.contacts(f).select("path", "text", F.col("order_key.at").alias("updated"))


@query(
    """SELECT company, text, updated FROM (SELECT 's' || s_suppkey AS company, '## s' || s_suppkey || CASE WHEN s_suppkey % 4 <> 0 THEN chr(10) || 'domain: d' || s_suppkey || ' · hq: n' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN ' · aka: a, b' ELSE '' END ELSE '' END
 || CASE WHEN s_suppkey % 6 <> 0 THEN chr(10) || 'notes of ' || s_name ELSE '' END AS text, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey % 31 AS BIGINT) ELSE greatest(CAST(s_suppkey % 97 AS BIGINT), CAST(s_suppkey % 31 AS BIGINT)) END AS updated, s_suppkey FROM supplier) WHERE NOT (s_suppkey % 4 = 0 AND s_suppkey % 6 = 0)"""
)
def vw_companies(spark, d):
    s, k, n = A.read(spark, d, "supplier"), F.col("s_suppkey"), _text("s_suppkey")
    facts = _json(domain=F.concat(F.lit("d"), n), hq=F.concat(F.lit("n"), _text("s_nationkey")), aliases=F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))))
    f = _files(s.filter(k % 4 != 0), F.concat(F.lit("companies/s"), n, F.lit("/facts.json")), facts, (k % 97).cast("long"))
    notes = F.when(k % 6 != 0, F.concat(F.lit(" notes of "), "s_name", F.lit("\n"))).otherwise(" \n")
    f = f.unionByName(_files(s, F.concat(F.lit("companies/s"), n, F.lit("/notes.md")), notes, (k % 31).cast("long")))
    return views.companies(f).select("company", "text", F.col("order_key.at").alias("updated"))


@query("SELECT DISTINCT 's' || s_suppkey AS company FROM supplier")
def agg_companies(spark, d):
    k = _text("s_suppkey")
    s = A.read(spark, d, "supplier")
    f = _files(s, F.concat(F.lit("companies/s"), k, F.lit("/notes.md")), F.lit("x"), F.lit(1).cast("long"))
    return views.company_names(f.unionByName(_files(s, F.concat(F.lit("companies/s"), k, F.lit("/facts.json")), F.lit("{}"), F.lit(2).cast("long"))))


def _people(spark, d) -> DataFrame:
    """Order dates as files of customers: a year each, and a status."""
    o = A.read(spark, d, "orders")
    key = F.concat(F.lit("@u"), F.lpad(F.hex("o_custkey"), 8, "0"))
    year = o.select(F.concat(F.lit("people/"), key, F.lit("/"), F.date_format("o_orderdate", "yyyy"), F.lit(".md")).alias("path"), F.lit("x").alias("body"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated"))
    status = o.select(F.concat(F.lit("people/"), key, F.lit("/status.md")).alias("path"), F.lit("x").alias("body"), F.lit("1990-01-01").alias("updated"))
    return year.groupBy("path").agg(F.first("body").alias("body"), F.max("updated").alias("updated")).unionByName(status.distinct())


@query("SELECT '@u' || lpad(printf('%X', o_custkey), 8, '0') AS key, CAST(count(DISTINCT year(o_orderdate)) + 1 AS BIGINT) AS files, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years, strftime(max(o_orderdate), '%Y-%m-%d') AS last_updated FROM orders GROUP BY o_custkey")
def agg_people(spark, d):
    return views.persons(_people(spark, d)).select("key", "files", F.array_join("years", ",").alias("years"), "last_updated")


@query(
    """SELECT 'job_offers/b/' || p_partkey || '.json' AS path, '- **' || CASE WHEN p_partkey % 3 = 0 THEN 'senior ' || p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE p_brand END || '** @ ' || CASE WHEN p_partkey % 5 = 0 THEN '?' ELSE 'co' || p_size END || ' — '
 || CASE WHEN p_partkey % 4 = 0 THEN '~$' || p_size || 'k±2k/yr' ELSE 'comp n/a' END || CASE WHEN p_partkey % 2 = 0 THEN ' — remote/Rome' ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' — closed' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN ' — [top]' ELSE '' END AS text, '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS posted FROM part"""
)
def vw_offers(spark, d):
    k, n = F.col("p_partkey"), _text("p_partkey")
    pay = F.when(k % 4 == 0, F.struct((F.col("p_size") * 1000.0).alias("net_yearly_usd_mean"), F.lit(4e6).alias("variance")))
    body = _json(posted_at=F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")), company=F.when(k % 5 != 0, F.concat(F.lit("co"), _text("p_size"))), grade=F.when(k % 3 == 0, "senior").otherwise("unknown"), specialization=F.when(k % 3 != 1, F.col("p_brand")).otherwise("other"), title_raw=F.col("p_name"), reward=pay, work_mode=F.when(k % 2 == 0, "remote").otherwise("unknown"), location=F.when(k % 2 == 0, "Rome").otherwise(""), status=F.when(k % 7 == 0, "closed").otherwise("open"), tier=F.when(k % 11 == 0, "top"))
    f = _files(A.read(spark, d, "part"), F.concat(F.lit("job_offers/b/"), n, F.lit(".json")), body, F.lit(1).cast("long"))
    return views.offers(f).select("path", "text", F.col("order_key.at").alias("posted"))


STUDY = "std AS (SELECT p_partkey AS k, 'study/c' || p_partkey || '/' || (1995 + p_partkey % 4) || CASE WHEN p_partkey % 3 = 0 THEN '-fall' ELSE '-spring' END || '.md' AS path, (1995 + p_partkey % 4) || CASE WHEN p_partkey % 3 = 0 THEN '-fall' ELSE '-spring' END AS term, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_name END AS body FROM part)"


def _study(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    term = F.concat((1995 + k % 4).cast("string"), F.when(k % 3 == 0, "-fall").otherwise("-spring"))
    return _files(A.read(spark, d, "part"), F.concat(F.lit("study/c"), k.cast("string"), F.lit("/"), term, F.lit(".md")), F.when(k % 5 == 0, " ").otherwise(F.col("p_name")), F.lit(1).cast("long"))


@query("SELECT path, '## c' || k || ' ' || term || chr(10) || chr(10) || body AS text, CAST(row_number() OVER (ORDER BY substr(term,1,4), term LIKE '%fall', 'c' || k) AS BIGINT) AS place FROM std WHERE trim(body) <> ''", STUDY)
def vw_study(spark, d):
    from pyspark.sql import Window as W

    return views.study(_study(spark, d)).withColumn("place", F.row_number().over(W.orderBy("order_key")).cast("long")).select("path", "text", "place")


@query("SELECT path, '## ' || lang || '/' || doc_id || '.md' || chr(10) || chr(10) || body AS text, updated FROM (SELECT 'code/' || lang || '/' || doc_id || '.md' AS path, lang, doc_id, updated, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS body FROM fil) WHERE body <> ''", A.FILES)
def vw_code(spark, d):
    f = A.files(spark, d)
    return views.code(_files(f, F.concat(F.lit("code/"), "lang", F.lit("/"), _text("doc_id"), F.lit(".md")), F.col("body"), F.col("updated"))).select("path", "text", F.col("order_key.at").alias("updated"))


@query("SELECT '## t' || item_id % 3 || ' › i' || item_id || chr(10) || chr(10) || text AS text FROM (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM benchmark) WHERE text <> ''")
def vw_insights(spark, d):
    b = A.read(spark, d, "benchmark")
    path = F.concat(F.lit("insights/t"), (F.col("item_id") % 3).cast("string"), F.lit("/i"), _text("item_id"), F.lit(".md"))
    return views.insights(_files(b, path, F.col("text"), F.lit(1).cast("long"))).select("text")


@query("SELECT path, CAST(i AS BIGINT) AS place, text FROM (SELECT path, unnest(range(2)) * 2 AS i, unnest([item, 'two']) AS text FROM (SELECT * FROM (VALUES ('market.md'), ('shortlist.md')) p(path), (SELECT 'one ' || s_name AS item FROM supplier WHERE s_suppkey = 1)))")
def vw_market(spark, d):
    """Single files by paragraph: blank ones go, and keep their place."""
    s = A.read(spark, d, "supplier").filter("s_suppkey = 1")
    f = s.select(F.explode(F.array(F.lit("market.md"), F.lit("shortlist.md"))).alias("path"), F.concat(F.lit("one "), "s_name", F.lit("\n\n \n\ntwo")).alias("body"))
    b = sections.Section("market").blocks(f).unionByName(sections.Section("shortlist").blocks(f))
    return b.select("path", F.col("order_key").cast("long").alias("place"), "text")


TAPER = """tpr AS (SELECT period, tier FROM lve a WHERE year < '1998' AND (tier = 'year' OR NOT EXISTS (SELECT 1 FROM lve y WHERE y.tier = 'year' AND y.period = a.year))
  AND (tier IN ('year', 'quarter') OR NOT EXISTS (SELECT 1 FROM lve q WHERE q.tier = 'quarter' AND q.period = a.quarter)) AND (tier <> 'day' OR NOT EXISTS (SELECT 1 FROM lve m WHERE m.tier = 'month' AND m.period = a.month))
 UNION ALL SELECT period, tier FROM lve a WHERE year = '1998' AND quarter < '1998-q3' AND (tier = 'quarter' OR NOT EXISTS (SELECT 1 FROM lve q WHERE q.tier = 'quarter' AND q.period = a.quarter)) AND (tier <> 'day' OR NOT EXISTS (SELECT 1 FROM lve m WHERE m.tier = 'month' AND m.period = a.month))
 UNION ALL SELECT period, tier FROM lve a WHERE quarter = '1998-q3' AND tier IN ('month', 'day') AND month < '1998-08' AND (tier = 'month' OR NOT EXISTS (SELECT 1 FROM lve m WHERE m.tier = 'month' AND m.period = a.month))
 UNION ALL SELECT period, tier FROM lve WHERE tier = 'day' AND month = '1998-08' AND period <= '1998-08-20'
 UNION ALL SELECT period, tier FROM lve WHERE tier = 'month' AND period = '1998-08' AND NOT EXISTS (SELECT 1 FROM lve WHERE tier = 'day' AND month = '1998-08' AND period <= '1998-08-20'))"""
DISPLAY = "CASE WHEN period LIKE '%q%' THEN substr(period,1,4) || ' Q' || substr(period,7,1) WHEN length(period) = 7 THEN strftime(CAST(period || '-01' AS DATE), '%Y %B') ELSE period END"
ORDER = "CASE WHEN length(period) = 4 THEN period || '-00-00' WHEN period LIKE '%q%' THEN substr(period,1,4) || '-' || lpad(CAST(CAST(substr(period,7,1) AS INTEGER)*3-2 AS VARCHAR), 2, '0') || '-00' WHEN length(period) = 7 THEN period || '-00' ELSE period END"


@query(f"SELECT period, {ORDER} AS order_key, '## ' || {DISPLAY} || chr(10) || chr(10) || body AS text FROM tpr JOIN hst USING (period)", A.HISTORY, LIVE, TAPER)
def vw_history(spark, d):
    return history.blocks(A.history(spark, d), "1998-08-20")


# ------------------------------------------------------------------ budgets and assembly


@query("SELECT i, CASE WHEN i = 0 THEN 0.333 ELSE least(0.9, greatest(0.1, i / 10.0)) END AS share FROM (SELECT n_nationkey AS i FROM nation)")
def bud_share(spark, d):
    i = F.col("n_nationkey")
    return A.read(spark, d, "nation").select(i.alias("i"), budget.share(F.when(i == 0, "none").otherwise((i / 10.0).cast("string"))).alias("share"))


BLOCKS = f"blk AS (SELECT lang AS per, source AS section, doc_id, updated, body, {TOK.format('body')} AS cost FROM fil WHERE trim(body) <> '')"
VIEW = f"cst AS (SELECT per, section, CAST({TOK.format('v')} AS BIGINT) AS cost FROM (SELECT per, section, '# ' || upper(left(section,1)) || lower(substr(section,2)) || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10)) AS v FROM blk GROUP BY per, section))"


def _blocks(spark, d) -> DataFrame:
    return A.files(spark, d).select(F.col("lang").alias("per"), F.col("source").alias("section"), "body", "updated", "doc_id")


@query("SELECT per, section, cost FROM cst", A.FILES, BLOCKS, VIEW)
def view_costs(spark, d):
    return view_cost(_blocks(spark, d), ["per", "section"], title_of(F.col("section")))


@query("SELECT lang AS per, CAST(greatest(1, length('# Files' || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10))) // 4) AS BIGINT) AS cost FROM fil WHERE trim(body) <> '' GROUP BY lang", A.FILES)
def view_cost_of_one(spark, d):
    return view_cost(A.files(spark, d).withColumnRenamed("lang", "per"), ["per"], F.lit("# Files"))


RUN = "run AS (SELECT *, sum(cost) OVER w AS running, row_number() OVER w AS k FROM blk WINDOW w AS (PARTITION BY per, section ORDER BY updated DESC, doc_id DESC ROWS UNBOUNDED PRECEDING))"


@query(
    f"""SELECT lang, doc_id, CAST(running AS BIGINT) AS running, CAST(n - count(*) OVER (PARTITION BY lang) AS BIGINT) AS left_out FROM (SELECT lang, doc_id, sum(cost) OVER w AS running, row_number() OVER w AS k, count(*) OVER (PARTITION BY lang) AS n
 FROM (SELECT *, {TOK.format('body')} AS cost FROM fil WHERE trim(body) <> '') WINDOW w AS (PARTITION BY lang ORDER BY updated DESC, doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE k = 1 OR 10 + running <= 5000""",
    A.FILES,
)
def crop(spark, d):
    return budget.crop(A.files(spark, d), F.lit(5000), F.lit(10), ["lang"], ["updated", "doc_id"], 5000, "body").select("lang", "doc_id", "running", "left_out")


TEXTS = """kpt AS (SELECT r.*, CAST(f.share AS BIGINT) AS share, k2.kept FROM run r JOIN fill f ON r.per = f.per AND r.section = f.section, LATERAL (SELECT r.k = 1 OR greatest(1, length('# ' || r.section) // 4) + r.running <= f.share AS kept) k2)"""
WHOLE = "'# ' || upper(left(section,1)) || lower(substr(section,2)) || chr(10) || chr(10) || CASE WHEN count(*) FILTER (NOT kept) > 0 THEN '_[… ' || count(*) FILTER (NOT kept) || ' older item(s) trimmed to fit context …]_' || chr(10) || chr(10) ELSE '' END || string_agg(body, chr(10) || chr(10) ORDER BY updated, doc_id) FILTER (kept)"


@query(f"SELECT per, section, any_value(share) AS share, sha256({WHOLE}) AS digest FROM kpt GROUP BY per, section", A.FILES, BLOCKS, VIEW, _fill(20_000), RUN, TEXTS)
def assemble(spark, d):
    return assembled(_blocks(spark, d), 20000).select("per", "section", "share", F.sha2("text", 256).alias("digest"))


IN_REPORT = "blk AS (SELECT * FROM bl0 WHERE section IN ('src0', 'src2'))"


@query(f"SELECT per, section, any_value(share) AS share, sha256({WHOLE}) AS digest FROM kpt GROUP BY per, section", A.FILES, BLOCKS.replace("blk AS", "bl0 AS"), IN_REPORT, VIEW, _fill(9_000), RUN, TEXTS)
def assemble_report(spark, d):
    return assembled(_blocks(spark, d), 9000, in_report=["src0", "src2"]).select("per", "section", "share", F.sha2("text", 256).alias("digest"))


@query(f"SELECT per, section, {WHOLE} AS text FROM (SELECT *, k = 1 OR 1 + running <= 300 AS kept FROM run) GROUP BY per, section", A.FILES, BLOCKS, RUN)
def view_render(spark, d):
    """Each view on its own, cut to 300 tokens."""
    b = _blocks(spark, d).withColumn("of", F.concat("per", F.lit("|"), "section"))
    return assembled(b, 300, "of", "section").select(F.split("of", r"\|")[0].alias("per"), "section", "text")


# ------------------------------------------------------------------ triggers and the queue


def _diary(spark, d) -> DataFrame:
    h = A.history(spark, d)
    return _files(h, F.concat(F.lit("history/"), "period", F.lit(".md")), F.col("body"), F.lit(1).cast("long"))


GAPS = " UNION ALL ".join(f"SELECT {c} AS period FROM lve WHERE tier = '{f}' AND {c} < '{now}' AND {c} NOT IN (SELECT period FROM lve WHERE tier = '{c}') GROUP BY {c}" for f, c, now in (("day", "month", "1998-08"), ("month", "quarter", "1998-q3"), ("quarter", "year", "1998")))
PARTS = "SELECT month FROM lve WHERE tier = 'day' GROUP BY month UNION ALL SELECT quarter FROM lve WHERE tier = 'month' GROUP BY quarter UNION ALL SELECT year FROM lve WHERE tier = 'quarter' GROUP BY year"


@query(f"SELECT 'history/' || period || '.md' AS target, 'rollup:' || period AS key FROM ({GAPS})", A.HISTORY, LIVE)
def trg_rollup(spark, d):
    return triggers.rollups(triggers.Context(_diary(spark, d), "1998-08-20"))


@query(f"SELECT 'history/' AS target, 'rebuild:' || count(*) AS key FROM ({PARTS})", A.HISTORY, LIVE)
def trg_consolidate(spark, d):
    return triggers.rebuild(triggers.Context(_diary(spark, d), "1998-08-20"))


@query("SELECT path AS target, 'exam:1998-05-01:' || path AS key FROM std WHERE path LIKE '%/1998-fall.md' AND trim(body) <> ''", STUDY)
def trg_exam(spark, d):
    return triggers.exams(triggers.Context(_study(spark, d), "1998-08-20", boundary="1998-05-01"))


@query(
    f"""SELECT 'history' AS section, 'rollup' AS name, 'history/' || period || '.md' AS target, CAST(50 AS BIGINT) AS priority, CAST(3 AS BIGINT) AS created_batch, 'history:rollup:' || period AS dedup_key FROM ({GAPS})
 UNION ALL SELECT 'history', 'consolidate', 'history/', 20, 3, 'history:rebuild:' || count(*) FROM ({PARTS})
 UNION ALL SELECT 'study', 'exam', path, 55, 3, 'study:exam:1998-05-01:' || path FROM std WHERE path LIKE '%/1998-fall.md' AND trim(body) <> ''
 UNION ALL SELECT 'companies', 'consolidate', '', 20, 3, 'companies:consolidate'
 UNION ALL SELECT 'study', 'prune', path, 70 + least(30, floor(30.0 * (length(body) - 20) / 20)), 3, 'overflow:' || path FROM std WHERE length(body) > 20""",
    A.HISTORY,
    LIVE,
    STUDY,
)
def trg_fire(spark, d):
    files = _diary(spark, d).withColumn("char_limit", F.lit(100).cast("long")).unionByName(_study(spark, d).withColumn("char_limit", F.lit(20).cast("long")))
    spec = sections.build({"history": {}, "study": {}, "companies": {}})
    return triggers.fire(spec, files, "1998-08-20", 3, {"study:exam": "1998-03-01"}, ("finish",))[0]


@query("SELECT seq, priority, created_batch, dedup_key, tokens FROM tsk", TASKS)
def tq_persist(spark, d):
    """The queue, written and read again."""
    path = lineage.folder(spark)
    _tasks(spark, d).write.parquet(path)
    return spark.read.parquet(path)


@query(
    """SELECT dedup_key FROM (SELECT dedup_key, seq, coalesce(sum(tokens + 1500) OVER (ORDER BY eff DESC, created_batch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT *, priority + 3 * (31 - created_batch) AS eff, row_number() OVER (PARTITION BY dedup_key ORDER BY seq) AS k FROM tsk) WHERE k = 1) WHERE before < 40000 AND dedup_key LIKE '%purchase'""",
    TASKS,
)
def tq_requeue(spark, d):
    taken = budget.drain(budget.first_of_key(_tasks(spark, d)), 31, 40000)
    return budget.requeue(taken, taken.filter("dedup_key like '%purchase'")).select("dedup_key")


@query("SELECT reply, status, status = 400 AND (reply LIKE '%maximum context%' OR reply LIKE '%reduce the length%') AS too_long FROM (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'maximum context length is ' || p_size WHEN 1 THEN 'please reduce the length of ' || p_size WHEN 2 THEN 'busy' ELSE 'model is gone' END AS reply, CASE WHEN p_size % 5 = 0 THEN 500 ELSE 400 END AS status FROM part)")
def llm_overflow(spark, d):
    from .writer import is_overflow

    n, i = F.col("p_size"), F.col("p_size").cast("string")
    reply = F.when(n % 4 == 0, F.concat(F.lit("maximum context length is "), i)).when(n % 4 == 1, F.concat(F.lit("please reduce the length of "), i)).when(n % 4 == 2, "busy").otherwise("model is gone")
    p = A.read(spark, d, "part").select(reply.alias("reply"), F.when(n % 5 == 0, 500).otherwise(400).alias("status")).distinct()
    return p.withColumn("too_long", is_overflow(F.col("status"), F.col("reply")))

"""Registered queries, each with the same in SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import periods as P
from ..functions import text as X
from ..operators import budget, chains, history, identity, media, progress, rendering, store
from ..sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its name; views: adapters that the SQL starts with."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = (f"WITH RECURSIVE {', '.join(views)} " if views else "") + sql
        return fn

    return add


KEY = "'@u' || left(sha256('id:' || sender_id), 8)"
TOK = "greatest(1, length({}) // 4)"


# ------------------------------------------------------------------ sources and projections


@query("SELECT id, date, sender_id, reply_to, post_id, media_type FROM evt", A.EVENTS)
def src_events(spark, d):
    return A.events(spark, d).select("id", "date", "sender_id", "reply_to", "post_id", "media_type")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def src_variant(spark, d):
    v = F.variant_get(F.parse_json("props"), "$.k", "bigint")
    return A.read(spark, d, "events").groupBy(v.alias("k")).agg(F.count("*").alias("n"))


@query("SELECT id, substr(date,1,10) AS day, substr(date,12,5) AS clock FROM evt", A.EVENTS)
def prj_day(spark, d):
    return A.events(spark, d).select("id", X.day("date").alias("day"), X.clock("date").alias("clock"))


@query("SELECT id, CASE WHEN post_id IS NULL THEN 'message' WHEN post_id = id THEN 'post' ELSE 'comment' END AS kind FROM evt", A.EVENTS)
def prj_kind(spark, d):
    return A.events(spark, d).select("id", chains.kind().alias("kind"))


@query("SELECT user_id % 7 AS chat, CASE WHEN count(CASE WHEN event_type='click' THEN 1 END) > 0 THEN 'channel' ELSE 'group' END AS kind FROM events GROUP BY 1")
def prj_chatkind(spark, d):
    return A.read(spark, d, "events").groupBy((F.col("user_id") % 7).alias("chat")).agg(F.when(F.max(F.col("event_type") == "click"), "channel").otherwise("group").alias("kind"))


@query("SELECT period, length(regexp_replace(body, '[^A-Za-z0-9_]', '', 'g')) >= 2 AND NOT (body LIKE '(%)' AND length(body) < 160) AS live FROM hst", A.HISTORY)
def flt_content(spark, d):
    return A.history(spark, d).select("period", X.has_content("body").alias("live"))


# ------------------------------------------------------------------ identity


@query(f"SELECT DISTINCT sender_id, left(sha256('id:' || sender_id), 8) AS digest, {KEY} AS key FROM conv", A.CONVERSATIONS)
def id_key(spark, d):
    m = A.conversations(spark, d).select("sender_id").distinct()
    return m.select("sender_id", X.digest(F.concat(F.lit("id:"), F.col("sender_id").cast("string"))).alias("digest"), X.person_key("sender_id", F.lit(None)).alias("key"))


@query("SELECT DISTINCT s_name, '@u' || left(sha256('name:' || lower(trim(s_name))), 8) AS key, '@u' || left(sha256('mention:' || lower(s_name)), 8) AS mention FROM supplier")
def id_mention_key(spark, d):
    s = A.read(spark, d, "supplier").select("s_name").distinct()
    return s.select("s_name", X.person_key(F.lit(None).cast("long"), "s_name").alias("key"), X.mention_key(F.col("s_name")).alias("mention"))


@query(f"SELECT {KEY} AS key, min(sender_id) AS sender_id, min(sender_name) AS name, CAST(count(*) AS BIGINT) AS n_messages FROM evt GROUP BY sender_id", A.EVENTS)
def id_resolve(spark, d):
    return identity.people(A.events(spark, d)).select("key", "sender_id", F.get("names", F.lit(0)).alias("name"), "n_messages")


id_build_sql = "SELECT '@u' || left(sha256(CASE WHEN sender_id % 5 = 0 THEN 'name:' || lower(trim(sender_name)) ELSE 'id:' || sender_id END), 8) AS key FROM conv GROUP BY 1"


@query(id_build_sql, A.CONVERSATIONS)
def id_keys(spark, d):
    m = A.conversations(spark, d).withColumn("sender_id", F.when(F.col("sender_id") % 5 != 0, F.col("sender_id")))
    return identity.people(m).select("key").distinct()


@query("SELECT CAST(count(DISTINCT lower(trim(sender_name))) AS BIGINT) AS ungrounded FROM conv WHERE sender_id % 5 = 0", A.CONVERSATIONS)
def id_ungrounded(spark, d):
    m = A.conversations(spark, d).withColumn("sender_id", F.when(F.col("sender_id") % 5 != 0, F.col("sender_id")))
    return identity.people(m).agg(F.count_if(~F.col("grounded")).alias("ungrounded"))


@query(
    f"""SELECT key, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY key) = 1 THEN base ELSE base || '_' || substr(key, 3, 4) END AS label
 FROM (SELECT DISTINCT {KEY} AS key, '@' || sender_name AS base FROM conv)""",
    A.CONVERSATIONS,
)
def id_labels(spark, d):
    return identity.labels(identity.people(A.conversations(spark, d)))


def _spoken(spark, d) -> DataFrame:
    """Events whose text names others by handle and by id."""
    e = A.events(spark, d)
    return e.select("id", "sender_id", "sender_name", "date", F.concat(F.lit("ask @user"), (F.col("sender_id") % 13).cast("string"), F.lit(" about "), ((F.col("sender_id") * 7 + 1) % 160).cast("string"), F.lit(", x99 @me or @all")).alias("text"))


_SPOKEN = "spk AS (SELECT id, sender_id, sender_id % 13 AS h, (sender_id * 7 + 1) % 160 AS n FROM evt), ids AS (SELECT DISTINCT sender_id AS s FROM evt)"


@query("SELECT id, 'ask @u' || left(sha256('mention:user' || h), 8) || ' about ' || n || ', x99 @me or @all' AS text FROM spk", A.EVENTS, _SPOKEN)
def id_pseudo(spark, d):
    return _spoken(spark, d).select("id", X.pseudonymise("text").alias("text"))


@query("SELECT id, 'ask @user' || h || ' about ' || CASE WHEN s IS NULL THEN CAST(n AS VARCHAR) ELSE '@u' || left(sha256('id:' || n), 8) END || ', x99 @me or @all' AS text FROM spk LEFT JOIN ids ON s = n", A.EVENTS, _SPOKEN)
def id_scrub(spark, d):
    m = _spoken(spark, d)
    ids = m.select(F.col("sender_id").cast("string").alias("sender_id"), X.person_key("sender_id", "sender_name").alias("key")).distinct()
    return identity.lookups(m, X.NUMBER, 0, ids, "sender_id", "key").select("id", X.scrub_ids("text", F.col("found")).alias("text"))


@query(f"SELECT id, 'ask @user' || h || ' about ' || n || ', x99 ' || '@u' || left(sha256('id:' || sender_id), 8) || ' or @u1 @u2' AS text FROM spk", A.EVENTS, _SPOKEN)
def id_expand(spark, d):
    return _spoken(spark, d).select("id", X.expand_groups("text", F.lit("@u1 @u2"), X.person_key("sender_id", "sender_name")).alias("text"))


# ------------------------------------------------------------------ chains and atoms

ROOTS = """prt AS (SELECT m.id, p.id AS up FROM evt m LEFT JOIN evt p ON m.reply_to = p.id),
 wlk AS (SELECT id, id AS root FROM prt WHERE up IS NULL UNION ALL SELECT p.id, w.root FROM prt p JOIN wlk w ON p.up = w.id)"""
CONV_ROOTS = "crt AS (SELECT *, (id // 1000) * 1000 AS root FROM conv)"


def _chained(spark, d) -> DataFrame:
    return A.events(spark, d).withColumn("post_id", F.lit(None).cast("long"))


@query("SELECT id, root FROM wlk", A.EVENTS, ROOTS)
def chain_root(spark, d):
    return chains.roots(_chained(spark, d))


@query("SELECT m.id, p.id AS parent_id FROM evt m LEFT JOIN evt p ON m.reply_to = p.id", A.EVENTS)
def chain_parent(spark, d):
    return chains.with_parent(A.events(spark, d)).select("id", "parent_id")


@query(
    f"""SELECT root, CAST(count(*) AS BIGINT) AS n_members, arg_max(id, date || lpad(CAST(id AS VARCHAR), 12, '0')) AS leaf_id, max(date) AS leaf_date,
 arg_max({KEY}, date || lpad(CAST(id AS VARCHAR), 12, '0')) AS sender FROM crt GROUP BY root""",
    A.CONVERSATIONS,
    CONV_ROOTS,
)
def atoms_build(spark, d):
    return chains.atoms(chains.with_root(A.conversations(spark, d))).select("root", "n_members", "leaf_id", "leaf_date", "sender")


@query("SELECT root, CAST(count(*) AS BIGINT) AS n_members, max(date) AS leaf_date FROM wlk JOIN evt USING (id) GROUP BY root", A.EVENTS, ROOTS)
def atoms_extent(spark, d):
    return chains.atoms(chains.with_root(_chained(spark, d))).select("root", "n_members", "leaf_date")


@query("SELECT day, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM (SELECT m.id, coalesce(substr(p.date,1,10), substr(m.date,1,10)) AS day FROM evt m LEFT JOIN evt p ON p.id = m.post_id AND p.post_id = p.id) GROUP BY day", A.EVENTS)
def grp_day(spark, d):
    return chains.by_day(A.events(spark, d)).groupBy("day").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("SELECT post_id, array_to_string(list_sort(list(id) FILTER (id <> post_id)), ',') AS comments, bool_or(id = post_id) AS present FROM evt GROUP BY post_id", A.EVENTS)
def grp_posts(spark, d):
    p = chains.posts(A.events(spark, d))
    joined = F.array_join(F.transform("comments", lambda i: i.cast("string")), ",")
    return p.select("post_id", F.when(F.size("comments") > 0, joined).alias("comments"), "present")


@query("SELECT day, CAST(count(*) AS BIGINT) AS atoms FROM (SELECT root, max(substr(date,1,10)) AS day FROM crt GROUP BY root) GROUP BY day", A.CONVERSATIONS, CONV_ROOTS)
def grp_history(spark, d):
    a = chains.atoms(chains.with_root(A.conversations(spark, d)))
    return a.groupBy(X.day("leaf_date").alias("day")).agg(F.count("*").alias("atoms"))


# ------------------------------------------------------------------ rendering

@query(
    """SELECT id, CASE media_type WHEN 'photo' THEN CASE WHEN id % 2 = 0 THEN '[photo: d' || id || ']' ELSE '[photo: vision unavailable]' END
 WHEN 'video' THEN CASE WHEN id % 2 = 0 THEN '[video thumbnail: d' || id || ']' ELSE '[file: ' || CASE WHEN id % 3 = 0 THEN 'f' || id ELSE 'video' END || ' — thumbnail not described]' END
 WHEN 'file' THEN '[file: ' || CASE WHEN id % 3 = 0 THEN 'f' || id ELSE 'file' END || ']' ELSE '[' || media_type || ']' END AS slot FROM evt""",
    A.EVENTS,
)
def rnd_slots(spark, d):
    i = F.col("id").cast("string")
    desc, name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("d"), i)), F.when(F.col("id") % 3 == 0, F.concat(F.lit("f"), i))
    return A.events(spark, d).select("id", media.slots(F.col("media_type"), desc, name).alias("slot"))


@query("SELECT n_nationkey AS id, '  [poll' || CASE WHEN n_nationkey % 2 = 0 THEN ' (quiz)' ELSE '' END || ': ' || n_name || ']' || chr(10) || '    - yes — ' || n_regionkey || ' votes' || chr(10) || '    - no' || chr(10) || '    (' || n_nationkey || ' total voters' || CASE WHEN n_nationkey % 3 = 0 THEN ', closed' ELSE '' END || ')' AS text FROM nation")
def rnd_poll(spark, d):
    n = A.read(spark, d, "nation")
    options = F.array(F.struct(F.lit("yes").alias("text"), F.col("n_regionkey").cast("long").alias("voters")), F.struct(F.lit("no").alias("text"), F.lit(None).cast("long").alias("voters")))
    return n.select(F.col("n_nationkey").alias("id"), media.poll(F.col("n_name"), options, F.col("n_nationkey"), F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") % 3 == 0).alias("text"))


@query("SELECT conv_id*1000+turn AS id, '# ' || upper(role) || chr(10) || '```' || chr(10) || '# keep ' || role || chr(10) || '```' || chr(10) || '## ' || upper('end ' || conv_id) AS text FROM conversations")
def rnd_headers(spark, d):
    c = A.read(spark, d, "conversations")
    t = F.concat(F.lit("\n# "), F.col("role"), F.lit("\n```\n# keep "), F.col("role"), F.lit("\n```\n## end "), F.col("conv_id").cast("string"), F.lit("\n\n"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), X.upper_headers(t).alias("text"))


@query("SELECT p_partkey AS id, p_name AS what, p_brand AS text FROM part")
def prs_vision(spark, d):
    p = A.read(spark, d, "part")
    v = rendering.vision(F.concat(F.lit("===OCR===\n"), F.col("p_brand"), F.lit("\n===DESCRIPTION===\n"), F.col("p_name")))
    return p.select(F.col("p_partkey").alias("id"), v.alias("v")).select("id", "v.what", "v.text")


# ------------------------------------------------------------------ budget, packing, views


@query(f"SELECT id, CAST({TOK.format('text')} AS BIGINT) AS tokens FROM conv", A.CONVERSATIONS)
def tok_est(spark, d):
    return A.conversations(spark, d).select("id", X.tokens("text").alias("tokens"))


@query("SELECT n_nationkey AS i, CAST(floor(32000 * (0.1 + n_nationkey / 40.0)) - 500 AS BIGINT) AS summary, CAST(32000 - floor(32000 * (0.1 + n_nationkey / 40.0)) AS BIGINT) AS work FROM nation")
def bud_run(spark, d):
    part = F.floor(32000 * (0.1 + F.col("n_nationkey") / 40.0))
    return A.read(spark, d, "nation").select(F.col("n_nationkey").alias("i"), (part - 500).cast("long").alias("summary"), (32000 - part).cast("long").alias("work"))


@query("SELECT n_nationkey AS n, CAST(10000 // greatest(1, n_nationkey) AS BIGINT) AS share FROM nation")
def bud_equal(spark, d):
    return A.read(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.expr("10000 div greatest(1, n_nationkey)").alias("share"))


COSTS = f"cst AS (SELECT lang AS per, source AS section, CAST(sum({TOK.format('text')}) AS BIGINT) AS cost FROM documents GROUP BY 1, 2)"


def _costs(spark, d) -> DataFrame:
    return A.read(spark, d, "documents").groupBy(F.col("lang").alias("per"), F.col("source").alias("section")).agg(F.sum(X.tokens("text")).alias("cost"))


def _fill(total: int) -> str:
    """Max-min shares one row after the other: what is left over what are left, until one needs more."""
    fair = "(f.room - f.share) // (o.n - o.k + 1)"
    return f"""ord AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY per) AS n FROM cst WINDOW w AS (PARTITION BY per ORDER BY cost, section)),
 fill AS (SELECT per, section, k, n, cost, CASE WHEN cost > {total} // n THEN {total} // n END AS fixed, CASE WHEN cost > {total} // n THEN {total} // n ELSE cost END AS share, CAST({total} AS BIGINT) AS room FROM ord WHERE k = 1
  UNION ALL SELECT o.per, o.section, o.k, o.n, o.cost, CASE WHEN f.fixed IS NOT NULL THEN f.fixed WHEN o.cost > {fair} THEN {fair} END,
   CASE WHEN f.fixed IS NOT NULL THEN f.fixed WHEN o.cost > {fair} THEN {fair} ELSE o.cost END, f.room - f.share FROM ord o JOIN fill f ON o.per = f.per AND o.k = f.k + 1)"""


@query("SELECT per, section, CAST(share AS BIGINT) AS share FROM fill", A.FILES, COSTS, _fill(50_000))
def bud_alloc(spark, d):
    return budget.allocate(_costs(spark, d), F.lit(50000), ["per"]).select("per", "section", "share")


@query("SELECT doc_id, CAST(unnest(range(len(b))) AS BIGINT) AS position, unnest(b) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents)")
def vw_world(spark, d):
    return A.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("position", "text")).withColumn("position", F.col("position").cast("long"))


# ------------------------------------------------------------------ store and records


@query("SELECT p_partkey AS id, 'a/' || p_brand || '/' || p_partkey AS path FROM part")
def st_split(spark, d):
    raw = F.concat(F.lit(" \\a//"), F.col("p_brand"), F.lit("/ "), F.col("p_partkey").cast("string"), F.lit("/"))
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array_join(store.split_path(raw), "/").alias("path"))


@query("SELECT period, 'history/' || period || '.md' AS key, 'history' AS section, CAST(CASE length(period) WHEN 10 THEN 4000 WHEN 4 THEN 10000 ELSE 6000 END AS BIGINT) AS char_limit FROM hst", A.HISTORY)
def st_resolve(spark, d):
    r = store.resolve(F.concat(F.lit("/history/"), F.col("period"), F.lit(".md")))
    return A.history(spark, d).select("period", r.alias("r")).select("period", "r.key", "r.section", "r.char_limit")


RESET = "rst AS (SELECT key, max(seq) FILTER (op IN ('write', 'delete')) AS r FROM opl GROUP BY key)"


@query("SELECT key, string_agg(body, chr(10) || chr(10) ORDER BY seq) AS body FROM opl JOIN rst USING (key) WHERE op IN ('write', 'append') AND (r IS NULL OR seq >= r) GROUP BY key", A.OP_LOG, RESET)
def st_append(spark, d):
    return store.bodies(A.op_log(spark, d))


@query("SELECT key, arg_max(body, seq) AS body FROM opl WHERE op = 'write' GROUP BY key", A.OP_LOG)
def st_write(spark, d):
    log = A.op_log(spark, d).filter("op = 'write'")
    return store.bodies(log)


@query("SELECT key, arg_max(flag, seq) FILTER (flag IS NOT NULL) AS flag, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(quantity, seq) AS quantity FROM opl GROUP BY key", A.OP_LOG)
def st_patch(spark, d):
    return store.patched(A.op_log(spark, d), ["flag", "status", "quantity"])


@query("SELECT key, replace(body, ' ', ' (x) ') AS body FROM (SELECT key, arg_max(body, seq) AS body FROM opl WHERE op = 'write' GROUP BY key)", A.OP_LOG)
def st_edit(spark, d):
    log = A.op_log(spark, d).filter("op = 'write'").select("key", "seq", "op", "body", F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    edits = log.select("key").distinct().select("key", F.lit(10**6).cast("long").alias("seq"), F.lit("edit").alias("op"), F.lit(None).cast("string").alias("body"), F.lit(" ").alias("old"), F.lit(" (x) ").alias("new"))
    return store.folded(log.unionByName(edits))


@query("SELECT key, max(chat_time) AS last_updated FROM opl GROUP BY key", A.OP_LOG)
def st_last(spark, d):
    return store.last_updated(A.op_log(spark, d))


@query("SELECT path, CAST(length(body) - char_limit AS BIGINT) AS excess FROM fil WHERE length(body) > char_limit", A.FILES)
def st_oversize(spark, d):
    return store.oversized(A.files(spark, d)).select("path", "excess")


@query("SELECT key, status, total FROM rec WHERE key LIKE 'orders/1%' AND lower(status) LIKE '%o%' AND total >= 100000 AND priority IN ('1-URGENT', '2-HIGH') ORDER BY total DESC, key LIMIT 50", A.RECORDS)
def st_query(spark, d):
    return store.query(A.records(spark, d), "orders/1", {"status": "o", "total": ">=100000", "priority": ["1-URGENT", "2-HIGH"]}, "-total", 50).select("key", "status", "total")


@query("SELECT key FROM rec WHERE contains(lower(segment), 'auto')", A.RECORDS)
def q_substr(spark, d):
    r = A.records(spark, d)
    return r.filter(store.condition(r, "segment", "AUTO")).select("key")


@query("SELECT key, balance FROM rec WHERE balance < 1000", A.RECORDS)
def q_cmp(spark, d):
    r = A.records(spark, d)
    return r.filter(store.condition(r, "balance", "<1000")).select("key", "balance")


@query("SELECT key FROM rec WHERE priority IN ('5-LOW', '3-MEDIUM')", A.RECORDS)
def q_in(spark, d):
    r = A.records(spark, d)
    return r.filter(store.condition(r, "priority", ["5-LOW", "3-MEDIUM"])).select("key")


@query("SELECT key, balance FROM rec WHERE status = 'F' ORDER BY balance DESC NULLS FIRST, key LIMIT 200", A.RECORDS)
def q_sort(spark, d):
    return store.query(A.records(spark, d).filter("status = 'F'"), sort="-balance", limit=200).select("key", "balance")


@query("""SELECT key, '{"status":"' || status || '","segment":"' || segment || '"}' AS body FROM rec""", A.RECORDS)
def st_dump(spark, d):
    return store.dumped(A.records(spark, d), ["status", "segment"])


@query("SELECT key, status, segment FROM rec", A.RECORDS)
def st_parse(spark, d):
    files = store.dumped(A.records(spark, d), ["status", "segment"])
    return store.parsed(files, "status string, segment string").select("key", "record.status", "record.segment")


@query("SELECT segment, priority, CAST(count(*) AS BIGINT) AS n, min(total) AS low, max(total) AS high, CAST(count(DISTINCT status) AS BIGINT) AS states FROM rec GROUP BY CUBE (segment, priority)", A.RECORDS)
def agg_market(spark, d):
    return A.records(spark, d).cube("segment", "priority").agg(F.count("*").alias("n"), F.min("total").alias("low"), F.max("total").alias("high"), F.count_distinct("status").alias("states"))


@query("SELECT key, posted FROM rec WHERE status = 'O' AND date_diff('day', CAST(posted AS DATE), DATE '1998-09-02') >= 90", A.RECORDS)
def agg_expiry(spark, d):
    r = A.records(spark, d)
    return r.filter((F.col("status") == "O") & (P.days_between("posted", F.lit("1998-09-02")) >= 90)).select("key", "posted")


# ------------------------------------------------------------------ periods and history


@query("SELECT DISTINCT d, substr(d,1,7) AS month, substr(d,1,4) || '-q' || CAST((CAST(substr(d,6,2) AS INTEGER)+2)//3 AS VARCHAR) AS quarter FROM dys", A.HISTORY)
def dt_quarter(spark, d):
    days = A.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    return days.select("d", P.month_of(F.col("d")).alias("month"), P.quarter_of(F.col("d")).alias("quarter"))


@query("SELECT d, try_cast(d AS DATE) IS NOT NULL AS valid FROM (SELECT DISTINCT '2024-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS d FROM orders)")
def dt_valid(spark, d):
    o = A.read(spark, d, "orders")
    two = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    return o.select(F.concat(F.lit("2024-"), two(14), F.lit("-"), two(33)).alias("d")).distinct().select("d", P.is_day("d").alias("valid"))


@query("SELECT period, CASE WHEN length(period) = 10 THEN 'day' WHEN length(period) = 4 THEN 'year' WHEN period LIKE '%q%' THEN 'quarter' ELSE 'month' END AS tier FROM hst", A.HISTORY)
def dt_period(spark, d):
    return A.history(spark, d).select("period", P.tier("period").alias("tier"))


@query("SELECT period, CASE WHEN period LIKE '%q%' THEN substr(period,1,4) || ' Q' || substr(period,7,1) WHEN length(period) = 7 THEN strftime(CAST(period || '-01' AS DATE), '%Y %B') ELSE period END AS display FROM hst", A.HISTORY)
def dt_display(spark, d):
    return A.history(spark, d).select("period", P.display("period").alias("display"))


@query("SELECT period, CASE WHEN length(period) = 4 THEN period || '-00-00' WHEN period LIKE '%q%' THEN substr(period,1,4) || '-' || lpad(CAST(CAST(substr(period,7,1) AS INTEGER)*3-2 AS VARCHAR), 2, '0') || '-00' WHEN length(period) = 7 THEN period || '-00' ELSE period END AS sort FROM hst", A.HISTORY)
def dt_order(spark, d):
    return A.history(spark, d).select("period", P.order_key("period").alias("sort"))


@query("SELECT d, CASE WHEN month(CAST(d AS DATE)) >= 8 THEN year(CAST(d AS DATE)) || '-fall' WHEN month(CAST(d AS DATE)) = 1 THEN (year(CAST(d AS DATE)) - 1) || '-fall' ELSE year(CAST(d AS DATE)) || '-spring' END AS term FROM dys", A.HISTORY)
def dt_term(spark, d):
    days = A.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    return days.select("d", P.term("d").alias("term"))


@query("SELECT d, CAST(date_diff('day', DATE '1996-02-29', CAST(d AS DATE)) AS BIGINT) AS days FROM dys", A.HISTORY)
def dt_between(spark, d):
    days = A.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    return days.select("d", P.days_between(F.lit("1996-02-29"), "d").alias("days"))


@query("SELECT d, CAST(sum(CASE WHEN x > d AND x <= '1999-06-01' THEN 1 ELSE 0 END) AS BIGINT) AS n FROM dys, (SELECT CAST(y AS VARCHAR) || m AS x FROM range(1995, 2000) t(y), (VALUES ('-12-01'), ('-05-01')) v(m)) GROUP BY d", A.HISTORY)
def dt_deadline(spark, d):
    days = A.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    hits = F.when(F.substring("d", 1, 4).cast("int") <= 1999, F.size(P.crossed(F.col("d"), F.greatest(F.col("d"), F.lit("1999-06-01")), ["12-01", "05-01"])))
    return days.filter("d <= '1999-12-31'").select("d", F.size(F.filter(P.crossed(F.col("d"), F.greatest(F.col("d"), F.lit("1999-06-01")), ["12-01", "05-01"]), lambda x: x <= "1999-06-01")).cast("long").alias("n")).unionByName(days.filter("d > '1999-12-31'").select("d", F.lit(0).cast("long").alias("n")))


LIVE = """lve AS (SELECT period, CASE WHEN length(period) = 10 THEN 'day' WHEN length(period) = 4 THEN 'year' WHEN period LIKE '%q%' THEN 'quarter' ELSE 'month' END AS tier, substr(period,1,4) AS year,
 CASE WHEN length(period) = 4 THEN NULL WHEN period LIKE '%q%' THEN period ELSE substr(period,1,4) || '-q' || CAST((CAST(substr(period,6,2) AS INTEGER)+2)//3 AS VARCHAR) END AS quarter,
 CASE WHEN length(period) = 4 OR period LIKE '%q%' THEN NULL ELSE substr(period,1,7) END AS month FROM hst WHERE body NOT LIKE '(%)')"""


@query("SELECT tier, CAST(count(DISTINCT period) AS BIGINT) AS n FROM lve GROUP BY tier", A.HISTORY, LIVE)
def agg_index(spark, d):
    return history.index(A.history(spark, d).filter(X.has_content("body"))).groupBy("tier").agg(F.count_distinct("period").alias("n"))


@query(
    """SELECT period, tier FROM lve a WHERE year < '1998' AND (tier = 'year' OR NOT EXISTS (SELECT 1 FROM lve y WHERE y.tier = 'year' AND y.period = a.year))
  AND (tier IN ('year', 'quarter') OR NOT EXISTS (SELECT 1 FROM lve q WHERE q.tier = 'quarter' AND q.period = a.quarter)) AND (tier <> 'day' OR NOT EXISTS (SELECT 1 FROM lve m WHERE m.tier = 'month' AND m.period = a.month))
 UNION ALL SELECT period, tier FROM lve a WHERE year = '1998' AND quarter < '1998-q3' AND (tier = 'quarter' OR NOT EXISTS (SELECT 1 FROM lve q WHERE q.tier = 'quarter' AND q.period = a.quarter)) AND (tier <> 'day' OR NOT EXISTS (SELECT 1 FROM lve m WHERE m.tier = 'month' AND m.period = a.month))
 UNION ALL SELECT period, tier FROM lve a WHERE quarter = '1998-q3' AND tier IN ('month', 'day') AND month < '1998-08' AND (tier = 'month' OR NOT EXISTS (SELECT 1 FROM lve m WHERE m.tier = 'month' AND m.period = a.month))
 UNION ALL SELECT period, tier FROM lve WHERE tier = 'day' AND month = '1998-08' AND period <= '1998-08-20'
 UNION ALL SELECT period, tier FROM lve WHERE tier = 'month' AND period = '1998-08' AND NOT EXISTS (SELECT 1 FROM lve WHERE tier = 'day' AND month = '1998-08' AND period <= '1998-08-20')""",
    A.HISTORY,
    LIVE,
)
def agg_taper(spark, d):
    return history.taper(A.history(spark, d), "1998-08-20")


@query("SELECT max(period) AS day FROM lve WHERE tier = 'day'", A.HISTORY, LIVE)
def agg_latest(spark, d):
    return history.index(A.history(spark, d).filter(X.has_content("body"))).filter("tier = 'day'").agg(F.max("period").alias("day"))


GAPS = " UNION ALL ".join(f"SELECT {c} AS period, '{c}' AS tier, array_to_string(list_sort(list(DISTINCT period)), ',') AS sources FROM lve WHERE tier = '{f}' AND {c} < '{now}' AND {c} NOT IN (SELECT period FROM lve WHERE tier = '{c}') GROUP BY {c}" for f, c, now in (("day", "month", "1998-08"), ("month", "quarter", "1998-q3"), ("quarter", "year", "1998")))


@query(GAPS, A.HISTORY, LIVE)
def agg_gaps(spark, d):
    return history.gaps(A.history(spark, d), "1998-08-20").select("period", "tier", F.array_join("sources", ",").alias("sources"))


@query(" UNION ALL ".join(f"SELECT {c} AS period, CAST({k} AS BIGINT) AS level, array_to_string(list_sort(list(DISTINCT period)), ',') AS sources FROM lve WHERE tier = '{f}' GROUP BY {c}" for k, (f, c) in enumerate((("day", "month"), ("month", "quarter"), ("quarter", "year")))), A.HISTORY, LIVE)
def agg_rebuild(spark, d):
    return history.plan(A.history(spark, d).filter(X.has_content("body"))).select("period", "level", F.array_join("sources", ",").alias("sources"))


# ------------------------------------------------------------------ progress, triggers, queue

DONE = """atm AS (SELECT root, CAST(count(*) AS BIGINT) AS n, list_sort(list(date)) AS dates FROM crt GROUP BY root),
 dne AS (SELECT s.section, root, n - root // 1000 % 3 AS c, dates[n - root // 1000 % 3] AS leaf FROM atm, (VALUES ('people'), ('history')) s(section) WHERE n > root // 1000 % 3 AND root // 1000 % 4 <> 0),
 sts AS (SELECT s.section, a.root, n, dates, c, leaf, CASE WHEN c IS NULL THEN 'new' WHEN c >= n THEN 'finished' ELSE 'partial' END AS status FROM atm a CROSS JOIN (VALUES ('people'), ('history'), ('world')) s(section) LEFT JOIN dne ON dne.section = s.section AND dne.root = a.root)"""
SECTIONS = ["people", "history", "world"]


def _status(spark, d) -> DataFrame:
    a = chains.atoms(chains.with_root(A.conversations(spark, d)))
    k = F.floor(F.col("root") / 1000)
    c = F.col("n_members") - k % 3
    done = a.filter((c > 0) & (k % 4 != 0)).select(F.explode(F.array(F.lit("people"), F.lit("history"))).alias("section"), "root", c.alias("done_count"), F.element_at("members", c.cast("int"))["date"].alias("done_leaf"))
    return progress.status(a, done, SECTIONS)


@query("SELECT section, root, status FROM sts", A.CONVERSATIONS, CONV_ROOTS, DONE)
def inc_status(spark, d):
    return _status(spark, d).select("section", "root", "status")


SINCE = "CASE WHEN status = 'partial' AND len(list_filter(dates, lambda x: x <= leaf)) = c THEN c ELSE 0 END"


@query(f"SELECT section, root, CAST({SINCE} AS BIGINT) AS since FROM sts", A.CONVERSATIONS, CONV_ROOTS, DONE)
def inc_since(spark, d):
    return _status(spark, d).select("section", "root", progress.since().cast("long").alias("since"))


@query(f"SELECT section, root, CAST(CASE WHEN {SINCE} > 0 THEN n - c + 1 ELSE n END AS BIGINT) AS fed FROM sts", A.CONVERSATIONS, CONV_ROOTS, DONE)
def inc_delta(spark, d):
    return _status(spark, d).withColumn("since", progress.since()).select("section", "root", F.size(progress.delta()).cast("long").alias("fed"))


@query("SELECT section, root FROM sts WHERE status <> 'finished'", A.CONVERSATIONS, CONV_ROOTS, DONE)
def inc_fresh(spark, d):
    return _status(spark, d).filter("status <> 'finished'").select("section", "root")


@query("SELECT section, root, n AS done_count, dates[n] AS done_leaf FROM sts", A.CONVERSATIONS, CONV_ROOTS, DONE)
def inc_commit(spark, d):
    s = _status(spark, d)
    done = s.filter("done_count is not null").select("section", "root", "done_count", "done_leaf")
    return progress.commit(done, s)


@query("SELECT section, bool_or(status <> 'finished') AS pending FROM sts GROUP BY section", A.CONVERSATIONS, CONV_ROOTS, DONE)
def agg_pending(spark, d):
    return _status(spark, d).groupBy("section").agg(F.max(F.col("status") != "finished").alias("pending"))


@query(
    """SELECT rule, day FROM fir""",
    "dy AS (SELECT user_id % 5 AS rule, strftime(ts, '%Y-%m-%d') AS day FROM events GROUP BY 1, 2)",
    """fir AS (SELECT rule, min(day) AS day FROM dy GROUP BY rule UNION ALL SELECT f.rule, (SELECT min(day) FROM dy WHERE dy.rule = f.rule AND date_diff('day', CAST(f.day AS DATE), CAST(dy.day AS DATE)) >= 7) FROM fir f
 WHERE EXISTS (SELECT 1 FROM dy WHERE dy.rule = f.rule AND date_diff('day', CAST(f.day AS DATE), CAST(dy.day AS DATE)) >= 7))""",
)
def trg_days(spark, d):
    days = A.read(spark, d, "events").select((F.col("user_id") % 5).alias("rule"), F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return progress.every_days(days, 7)


@query("SELECT path AS target, CAST(70 + least(30, floor(30.0 * (length(body) - char_limit) / char_limit)) AS BIGINT) AS priority, 'overflow:' || path AS dedup_key FROM fil WHERE length(body) > char_limit", A.FILES)
def trg_overflow(spark, d):
    return progress.overflow_tasks(store.oversized(A.files(spark, d)))


TASKS = "tsk AS (SELECT event_id AS seq, CAST(CASE event_type WHEN 'purchase' THEN 100 WHEN 'click' THEN 50 ELSE 20 END AS BIGINT) AS priority, CAST(strftime(ts, '%d') AS BIGINT) AS created_batch, user_id || ':' || event_type AS dedup_key, length(props) * 10 AS tokens FROM events)"


def _tasks(spark, d) -> DataFrame:
    e, kind = A.read(spark, d, "events"), F.col("event_type")
    priority = F.when(kind == "purchase", 100).when(kind == "click", 50).otherwise(20)
    return e.select(F.col("event_id").alias("seq"), priority.cast("long").alias("priority"), F.dayofmonth("ts").cast("long").alias("created_batch"), F.concat(F.col("user_id").cast("string"), F.lit(":"), kind).alias("dedup_key"), (F.length("props") * 10).cast("long").alias("tokens"))


@query("SELECT dedup_key, min(seq) AS seq FROM tsk GROUP BY dedup_key", TASKS)
def tq_add(spark, d):
    return budget.first_of_key(_tasks(spark, d)).select("dedup_key", "seq")


@query("SELECT seq, CAST(priority + 3 * (31 - created_batch) AS BIGINT) AS eff FROM tsk ORDER BY eff DESC, created_batch, seq LIMIT 1", TASKS)
def tq_pop(spark, d):
    return _tasks(spark, d).withColumn("eff", F.col("priority") + 3 * (31 - F.col("created_batch"))).orderBy(F.col("eff").desc(), "created_batch", "seq").limit(1).select("seq", "eff")


@query(
    """SELECT seq, place FROM (SELECT seq, row_number() OVER w AS place, coalesce(sum(tokens + 1500) OVER (ORDER BY eff DESC, created_batch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT *, priority + 3 * (31 - created_batch) AS eff, row_number() OVER (PARTITION BY dedup_key ORDER BY seq) AS k FROM tsk) WHERE k = 1 WINDOW w AS (ORDER BY eff DESC, created_batch, seq)) WHERE before < 40000""",
    TASKS,
)
def tq_drain(spark, d):
    t = budget.drain(budget.first_of_key(_tasks(spark, d)), 31, 40000)
    return t.select("seq", "place")

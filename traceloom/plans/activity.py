"""More operators over the driver's tables: files and sessions, checks, assets, discovery, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost, joins, ledger, quality, scan, search, turns
from ..sources import transcripts
from .queries import _KIND_SQL, _LOOPS, _RESOLVES, _USAGE, _ledger, _priced, _t, query

_TOUCHES = "SELECT l_partkey AS path, CASE l_linenumber % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'edit' ELSE 'human' END AS kind, CAST(l_quantity AS BIGINT) AS growth, l_orderkey AS session_id, l_suppkey AS branch, strftime(l_shipdate, '%Y-%m-%d') AS ts, l_orderkey AS transcript, l_linenumber AS \"offset\" FROM lineitem"
_ACTIVITY = f"SELECT path, count(*) FILTER (WHERE kind = 'read') AS reads, count(*) FILTER (WHERE kind = 'write') AS writes, count(*) FILTER (WHERE kind = 'edit') AS edits, count(*) FILTER (WHERE kind = 'human') AS human_edits, CAST(coalesce(sum(growth), 0) AS BIGINT) AS net_growth, count(DISTINCT session_id) AS sessions, count(DISTINCT branch) AS branches, min(ts) AS first_touch, max(ts) AS last_touch FROM ({_TOUCHES}) GROUP BY path"


def _touches(spark, sf_dir):
    kind = "CASE l_linenumber % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'edit' ELSE 'human' END AS kind"
    return _t(spark, sf_dir, "lineitem").selectExpr("l_partkey AS path", kind, "CAST(l_quantity AS BIGINT) AS growth", "l_orderkey AS session_id", "l_suppkey AS branch", "date_format(l_shipdate, 'yyyy-MM-dd') AS ts", "l_orderkey AS transcript", "l_linenumber AS offset")


@query("file_activity", _ACTIVITY)
def file_activity(spark, sf_dir):
    return cost.file_activity(_touches(spark, sf_dir))


@query("top_files", f"SELECT path, reads + writes + edits AS touches FROM ({_ACTIVITY}) ORDER BY touches DESC, path LIMIT 80")
def top_files(spark, sf_dir):
    return cost.top_files(file_activity(spark, sf_dir)).select("path", "touches")


@query("latest_touches", f"""
WITH one AS (SELECT path, branch AS session_id, ts, transcript, "offset", row_number() OVER (PARTITION BY path, branch ORDER BY ts DESC, transcript DESC, "offset" DESC) AS k FROM ({_TOUCHES}))
SELECT path, session_id, ts, transcript, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, transcript DESC, "offset" DESC) AS n FROM one WHERE k = 1) WHERE n <= 40""")
def latest_touches(spark, sf_dir):
    return cost.latest_touches(_touches(spark, sf_dir).withColumn("session_id", F.col("branch")))


@query("co_change_written", """
WITH t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08))
SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS sessions FROM t x JOIN t y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL""")
def co_change_written(spark, sf_dir):
    item = _t(spark, sf_dir, "lineitem")
    return cost.co_change(item, "l_orderkey", "l_partkey", item.filter("l_discount > 0.08").select("l_partkey"))


@query("session_signals", """
WITH t AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS tools FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) GROUP BY 1)
SELECT e.user_id AS session_id, count(*) FILTER (WHERE event_type = 'signup') AS prompts, count(*) FILTER (WHERE event_type NOT IN ('signup', 'error')) AS assistant_turns, count(*) FILTER (WHERE event_type = 'error') AS results, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(0 AS BIGINT) AS compactions, any_value(t.tools) AS tools FROM events e LEFT JOIN t ON t.user_id = e.user_id GROUP BY 1""")
def session_signals(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("user_id AS session_id", f"{_KIND_SQL} AS event_type", "CASE WHEN event_type IN ('click', 'view') THEN event_type END AS tool_name")
    listed = F.array_join(F.transform(F.map_entries("tools"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return cost.session_signals(e).withColumn("tools", listed)


@query("usage_by_model", "SELECT l_suppkey AS session_id, l_returnflag AS model, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS output_tokens, CAST(sum(l_linenumber) AS BIGINT) AS cache_read_tokens, count(*) AS cache_creation_tokens, CAST(sum(l_partkey) AS BIGINT) AS thinking_tokens, count(*) AS request_count FROM lineitem GROUP BY ALL")
def usage_by_model(spark, sf_dir):
    return turns.usage_by_model(_t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS session_id", "l_returnflag AS model", "CAST(l_quantity AS BIGINT) AS input_tokens", "CAST(round(l_extendedprice) AS BIGINT) AS output_tokens", "CAST(l_linenumber AS BIGINT) AS cache_read_tokens", "1L AS cache_creation_tokens", "l_partkey AS thinking_tokens"))


@query("model_totals", f"SELECT model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation FROM ({_USAGE}) GROUP BY 1")
def model_totals(spark, sf_dir):
    return cost.totals(_priced(spark, sf_dir))[1]


@query("branch_index", "SELECT c_nationkey AS branch, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS kinds, CAST(sum(CAST(round(c_acctbal) AS BIGINT)) AS BIGINT) AS total FROM customer GROUP BY 1")
def branch_index(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").selectExpr("c_nationkey AS branch", "c_mktsegment AS kinds", "CAST(round(c_acctbal) AS BIGINT) AS total")
    return cost.index_by(rows, "branch", ["kinds"], ["total"]).withColumn("kinds", F.array_join("kinds", ","))


@query("folder_sessions", """
WITH per AS (SELECT l_suppkey AS cwd, l_orderkey AS session_id, strftime(max(l_shipdate), '%Y-%m-%d') AS mtime, 'n' || min(l_linenumber) FILTER (WHERE l_linenumber > 2) AS subject FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cwd ORDER BY mtime DESC, session_id DESC) AS k FROM per)
SELECT cwd, count(*) AS sessions, max(mtime) AS latest, max(CASE WHEN k = 1 THEN session_id END) AS latest_session, coalesce(max(CASE WHEN k = 1 THEN subject END), max(subject)) AS subject FROM r GROUP BY cwd""")
def folder_sessions(spark, sf_dir):
    return ledger.sessions_per_cwd(_t(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS cwd", "l_orderkey AS session_id", "date_format(l_shipdate, 'yyyy-MM-dd') AS mtime", "CASE WHEN l_linenumber > 2 THEN 'n' || l_linenumber END AS subject", "l_linenumber AS offset"))


@query("worktree_conflicts", "SELECT l_orderkey AS path, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS slugs FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def worktree_conflicts(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").selectExpr("'worktree' AS kind", "l_orderkey AS name", "CAST(l_suppkey AS STRING) AS slug")
    return ledger.worktree_conflicts(rows).withColumn("slugs", F.array_join("slugs", ","))


@query("check_rollup", """
WITH c AS (SELECT l_orderkey AS pr, count(*) FILTER (WHERE l_returnflag = 'R') AS fail, count(*) FILTER (WHERE l_returnflag = 'N') AS pending, count(*) AS total FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN fail > 0 THEN 'fail ' || fail WHEN pending > 0 THEN 'pending ' || pending ELSE 'pass ' || total END || '/' || total AS summary FROM c""")
def check_rollup(spark, sf_dir):
    return ledger.check_rollup(_t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS pr", "CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'N' THEN 'pending' ELSE 'pass' END AS state"), "pr")


@query("conversation_summary", "SELECT conv_id AS session_id, left(coalesce(arg_max(text, turn) FILTER (WHERE text LIKE '%?%'), arg_min(text, turn) FILTER (WHERE role = 'user')), 150) AS summary FROM conversations GROUP BY 1")
def conversation_summary(spark, sf_dir):
    return ledger.session_summary(_t(spark, sf_dir, "conversations").selectExpr("conv_id AS session_id", "role", "text", "turn AS offset", "text LIKE '%?%' AS is_continuation"))


_SESSIONS = "SELECT o_custkey AS slug, 'f' || o_orderkey AS file, o_orderdate AS started, o_orderdate AS ended, CASE WHEN o_orderstatus = 'F' THEN 'canonical' ELSE 'parallel' END AS track FROM orders"
_NARRATIVE = f"SELECT slug, file, ended FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY track = 'canonical' DESC, ended DESC, file DESC) AS k FROM ({_SESSIONS})) WHERE k = 1"


def _sessions(spark, sf_dir):
    return _t(spark, sf_dir, "orders").selectExpr("o_custkey AS slug", "'f' || o_orderkey AS file", "o_orderdate AS started", "o_orderdate AS ended", "CASE WHEN o_orderstatus = 'F' THEN 'canonical' ELSE 'parallel' END AS track")


@query("narrative_session", f"SELECT slug, file FROM ({_NARRATIVE})")
def narrative_session(spark, sf_dir):
    return ledger.narrative(_sessions(spark, sf_dir)).select("slug", "file")


@query("parallel_sessions", f"SELECT s.slug, s.file FROM ({_SESSIONS}) s JOIN ({_NARRATIVE}) n ON n.slug = s.slug WHERE s.track <> 'canonical' AND s.ended > n.ended AND s.file <> n.file")
def parallel_sessions(spark, sf_dir):
    return ledger.parallel_sessions(_sessions(spark, sf_dir)).select("slug", "file")


@query("newest_notes", "SELECT * FROM (SELECT o_custkey AS slug, o_orderkey AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank, greatest(count(*) OVER (PARTITION BY o_custkey) - 12, 0) AS overflow FROM orders) WHERE rank <= 12")
def newest_notes(spark, sf_dir):
    return ledger.newest_notes(_t(spark, sf_dir, "orders").selectExpr("o_custkey AS slug", "o_orderkey AS title", "o_orderdate AS created")).drop("created")


def _tasks(spark, sf_dir):
    return _t(spark, sf_dir, "orders").selectExpr("o_custkey AS slug", "o_orderkey AS id", "CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS status", "CAST(o_orderdate AS DATE) AS done_at")


_NOW = "1998-10-03"


@query("stale_done", f"SELECT o_custkey AS slug, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) <= DATE '{_NOW}' - 400")
def stale_done(spark, sf_dir):
    return ledger.stale_done(_tasks(spark, sf_dir), F.lit(_NOW), 400).select("slug", "id")


@query("recently_done", f"SELECT o_custkey AS slug, count(*) AS recently_done FROM orders WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) > DATE '{_NOW}' - 14 GROUP BY 1")
def recently_done(spark, sf_dir):
    return ledger.recently_done(_tasks(spark, sf_dir), F.lit(_NOW))


@query("stale_loops", f"SELECT slug, ref, CAST(date_diff('day', ended, TIMESTAMP '1999-01-01') AS INT) AS age_days FROM ({_LOOPS}) l WHERE date_diff('day', ended, TIMESTAMP '1999-01-01') > 30 AND NOT EXISTS (SELECT 1 FROM ({_RESOLVES}) r WHERE r.problem IS NULL AND r.slug = l.slug AND r.ref = l.ref)")
def stale_loops(spark, sf_dir):
    opened, found = _ledger(spark, sf_dir)
    return ledger.stale_loops(ledger.open_ledger(opened, ledger.latest_resolution(found), F.lit("1999-01-01").cast("timestamp"))).select("slug", "ref", "age_days")


@query("session_list", "SELECT source AS slug, doc_id AS file, doc_id AS session_id, n_chars AS ended, left(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), 120) AS summary FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def session_list(spark, sf_dir):
    return ledger.session_list(_t(spark, sf_dir, "documents").selectExpr("source AS slug", "doc_id AS file", "doc_id AS session_id", "n_chars AS ended", "text AS body"))


@query("asset_upsert", "SELECT coalesce(b.id, m.id) AS id, coalesce(b.kind, m.kind) AS kind FROM (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS kind FROM customer) b FULL JOIN (SELECT p_partkey AS id, p_type AS kind FROM part) m ON m.id = b.id")
def asset_upsert(spark, sf_dir):
    base = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS kind")
    return joins.upsert_missing(base, _t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_type AS kind"), "id")


@query("branch_assets", "SELECT user_id, arg_min(props, event_id) FILTER (WHERE event_type = 'click' AND props IS NOT NULL) AS head, min(strftime(ts, '%Y-%m-%d')) AS first_seen, max(strftime(ts, '%Y-%m-%d')) AS last_seen FROM events GROUP BY 1")
def branch_assets(spark, sf_dir):
    day = "date_format(ts, 'yyyy-MM-dd')"
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", "event_id AS offset", "CASE WHEN event_type = 'click' THEN props END AS head", f"{day} AS first_seen", f"{day} AS last_seen")
    return turns.merge_assets(rows, "user_id", ["head"], ["first_seen"], ["last_seen"])


@query("merge_halves", "SELECT * FROM (SELECT user_id, arg_min(props, event_id) FILTER (WHERE event_type = 'signup' AND props IS NOT NULL) AS title, arg_min(value, event_id) FILTER (WHERE event_type = 'error' AND value IS NOT NULL) AS number FROM events GROUP BY 1) WHERE title IS NOT NULL AND number IS NOT NULL")
def merge_halves(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id", "'' AS path", "event_id AS offset", "CASE WHEN event_type = 'signup' THEN props END AS title", "CASE WHEN event_type = 'error' THEN value END AS number")
    return joins.merge_halves(rows, "user_id", ["title", "number"])


@query("tool_names", """
WITH e AS (SELECT user_id AS path, CAST(floor(value) AS BIGINT) % 5 AS tool_use_id, event_id AS "offset", event_type, props FROM events WHERE event_type IN ('click', 'error')),
m AS (SELECT *, lag(CASE WHEN event_type = 'click' THEN props END) OVER (PARTITION BY path, tool_use_id ORDER BY "offset") AS name FROM e)
SELECT path, tool_use_id, "offset", coalesce(name, 'generic') AS tool_name FROM m WHERE event_type = 'error'""")
def tool_names(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("user_id AS path", "CAST(floor(value) AS BIGINT) % 5 AS tool_use_id", "event_id AS offset", "event_type", "props AS name")
    return joins.tool_names(e.filter("event_type = 'error'").drop("event_type", "name"), e.filter("event_type = 'click'"))


@query("quarantine", """
WITH RECURSIVE l AS (SELECT user_id AS path, event_id, '{"k": ' || event_id || CASE WHEN event_id % 211 = 7 THEN '' ELSE ', "v": "' || repeat('x', CAST(event_id % 83 * (event_id % 83) // 20 AS INT)) || '"}' END AS text FROM events),
o AS (SELECT path, text, CAST(sum(length(text) + 1) OVER (PARTITION BY path ORDER BY event_id) AS BIGINT) AS "end", CAST(length(text) + 1 AS BIGINT) AS size, NOT ends_with(text, '}') AS bad FROM l),
b AS (SELECT path, min("end" - size) AS first_bad FROM o WHERE bad GROUP BY path),
n AS (SELECT f.path, f."end" - f.size AS start, max(o."end") AS nxt FROM o f JOIN b ON b.path = f.path JOIN o ON o.path = f.path AND o."end" <= f."end" - f.size + CAST(300 * pow(2, greatest(0, ceil(log2(f.size / 300.0)))) AS BIGINT) GROUP BY ALL),
c AS (SELECT path, CAST(0 AS BIGINT) AS start FROM b UNION ALL SELECT c.path, n.nxt FROM c JOIN n ON n.path = c.path AND n.start = c.start),
k AS (SELECT path, first_bad, max(start) AS kept_bytes FROM c JOIN b USING (path) WHERE start <= first_bad GROUP BY ALL)
SELECT o.path, count(CASE WHEN k.path IS NULL OR o."end" <= kept_bytes THEN 1 END) AS good, any_value(first_bad) AS first_bad_offset, any_value(kept_bytes) AS kept_bytes FROM o LEFT JOIN k USING (path) GROUP BY o.path""")
def quarantine(spark, sf_dir):
    e = _t(spark, sf_dir, "events").selectExpr("user_id AS path", "event_id", """'{"k": ' || event_id || CASE WHEN event_id % 211 = 7 THEN '' ELSE ', "v": "' || repeat('x', cast(event_id % 83 * (event_id % 83) div 20 AS int)) || '"}' END AS text""").withColumn("length", F.octet_length("text"))
    lines = scan.running(e, ["path"], ["event_id"], sums={"end": F.col("length") + 1}).withColumn("offset", F.col("end") - F.col("length") - 1)
    good, bad = transcripts.quarantining(lines.select("path", "offset", "length", "text"), 300)
    counts = e.select("path").distinct().join(good.groupBy("path").agg(F.count("*").alias("good")), "path", "left").fillna(0, ["good"])
    return counts.join(bad.drop("reason"), "path", "left").select("path", "good", "first_bad_offset", "kept_bytes")


@query("enrich_unique", "SELECT o_orderkey AS id, o_custkey, l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1 HAVING count(*) = 1) ON l_orderkey = o_orderkey")
def enrich_unique(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_custkey")
    return joins.enrich_unique(rows, _t(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_partkey"), "id")


@query("agent_ends", """
WITH a AS (SELECT o_custkey AS session_id, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 1000 END AS child_session_id, o_orderkey AS agent_ref FROM orders),
s AS (SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS child_ended_at FROM events GROUP BY 1),
p AS (SELECT child_session_id AS session_id, min(agent_ref) AS parent_ref FROM a WHERE child_session_id IS NOT NULL GROUP BY 1)
SELECT a.agent_ref, a.session_id, a.child_session_id, s.child_ended_at, p.parent_ref FROM a LEFT JOIN s ON s.user_id = a.child_session_id LEFT JOIN p ON p.session_id = a.session_id""")
def agent_ends(spark, sf_dir):
    agents = _t(spark, sf_dir, "orders").selectExpr("o_custkey AS session_id", "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 1000 END AS child_session_id", "o_orderkey AS agent_ref")
    ends = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("ended_at"))
    return joins.subagent_ends(agents, ends)


@query("outside_roots", r"""
WITH roots AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/?]+)', 1) AS root FROM pages WHERE page_id % 3 = 0)
SELECT page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE p.url = r.root OR starts_with(p.url, r.root || '/'))""")
def outside_roots(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", "url")
    roots = p.filter("page_id % 3 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[^/?]+)", 1).alias("root")).distinct()
    return joins.outside_roots(p, "url", roots).select("page_id")


@query("id_references", r"""
WITH w AS (SELECT 'd' || doc_id AS row_id, upper(unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS word FROM documents),
v AS (SELECT DISTINCT upper(word) AS id FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) WHERE length(word) >= 9)
SELECT row_id, word AS id FROM w JOIN v ON v.id = w.word""")
def id_references(spark, sf_dir):
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("id")).filter("length(id) >= 9").distinct()
    texts = _t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_id"), "text")
    return joins.references(words, texts).select("row_id", "id")


@query("discovery", """
WITH hits AS (SELECT 'x' || p_partkey AS ref, p_brand || '/' || p_name AS cwd FROM part UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier),
slugs AS (SELECT p_brand AS slug, min(p_partkey) AS place FROM part GROUP BY 1),
left_over AS (SELECT * FROM hits WHERE ref NOT IN (SELECT 'x' || p_partkey FROM part WHERE p_size > 40)),
m AS (SELECT h.ref, s.slug, row_number() OVER (PARTITION BY h.ref ORDER BY s.place) AS k FROM left_over h JOIN slugs s ON contains(lower(h.cwd), lower(s.slug)) OR contains(lower(h.ref), lower(s.slug)))
SELECT h.ref, h.cwd, m.slug, m.slug IS NOT NULL AS tracked FROM left_over h LEFT JOIN m ON m.ref = h.ref AND m.k = 1""")
def discovery(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    hits = [part.selectExpr("'x' || p_partkey AS ref", "p_brand || '/' || p_name AS cwd"), _t(spark, sf_dir, "supplier").selectExpr("'s' || s_suppkey AS ref", "s_name AS cwd")]
    slugs = part.groupBy(F.col("p_brand").alias("slug")).agg(F.min("p_partkey").alias("place"))
    return ledger.discovery(hits, slugs, part.filter("p_size > 40").selectExpr("'x' || p_partkey AS ref")).select("ref", "cwd", "slug", "tracked")


@query("search_orphans", r"SELECT doc_id AS span_id FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def search_orphans(spark, sf_dir):
    spans = _t(spark, sf_dir, "documents").selectExpr("doc_id AS span_id", "'text' AS field", "text")
    return search.orphans(search.index_spans(spans), _t(spark, sf_dir, "labels").selectExpr("doc_id AS span_id"))


@query("transcript_freshness", "SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(greatest(CAST(floor(o_totalprice) AS BIGINT) - o_custkey * 50, 0)) AS BIGINT) AS lag_bytes, max(strftime(o_orderdate, '%Y-%m-%d')) AS indexed_at FROM orders GROUP BY 1")
def transcript_freshness(spark, sf_dir):
    return quality.freshness(_t(spark, sf_dir, "orders").selectExpr("o_orderstatus AS status", "CAST(floor(o_totalprice) AS BIGINT) AS size", "o_custkey * 50 AS offset", "date_format(o_orderdate, 'yyyy-MM-dd') AS indexed_at"))


@query("missing_sources", "SELECT doc_id AS path, 'missing' AS status FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_sources(spark, sf_dir):
    recorded = _t(spark, sf_dir, "documents").selectExpr("doc_id AS path", "CASE WHEN lang = 'en' THEN 'ok' ELSE 'quarantined' END AS status")
    return quality.missing_sources(recorded, _t(spark, sf_dir, "labels").selectExpr("doc_id AS path"))


@query("ingest_funnel", """
WITH c AS (SELECT lang, count(*) AS seen, count(*) FILTER (WHERE n_chars > 500) AS medium, count(*) FILTER (WHERE n_chars > 2000) AS long FROM documents GROUP BY 1)
SELECT *, CASE WHEN seen = 0 THEN 1.0 ELSE round(medium / seen, 4) END AS medium_share, CASE WHEN medium = 0 THEN 1.0 ELSE round(long / medium, 4) END AS long_share FROM c""")
def ingest_funnel(spark, sf_dir):
    n = lambda most: F.count(F.when(F.col("n_chars") > most, 1))
    return quality.funnel(_t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("seen"), n(500).alias("medium"), n(2000).alias("long")), ["seen", "medium", "long"])


_CLAIMS = "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_custkey % 2 AS odd, t.status AS status_t, t.odd AS odd_t FROM orders JOIN (SELECT l_orderkey, max(l_linestatus) AS status, count(*) % 2 AS odd FROM lineitem GROUP BY 1) t ON l_orderkey = o_orderkey"


def _claims(spark, sf_dir):
    truth = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("status"), (F.count("*") % 2).alias("odd"))
    return _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status", "o_custkey % 2 AS odd"), truth


@query("attribute_accuracy", f"SELECT count(*) AS graded, count(*) FILTER (WHERE ok) AS \"right\", round(avg(ok::INT), 4) AS accuracy FROM (SELECT status IS NOT DISTINCT FROM status_t AND odd IS NOT DISTINCT FROM odd_t AS ok FROM ({_CLAIMS}))")
def attribute_accuracy(spark, sf_dir):
    return quality.attribute_accuracy(*_claims(spark, sf_dir), "k", ["status", "odd"])


@query("claim_accuracy", f"SELECT graded, \"right\", round(\"right\" / graded, 4) AS accuracy FROM (SELECT count(status) + count(odd) AS graded, count(*) FILTER (WHERE status = status_t) + count(*) FILTER (WHERE odd = odd_t) AS \"right\" FROM ({_CLAIMS}))")
def claim_accuracy(spark, sf_dir):
    return quality.attribute_accuracy(*_claims(spark, sf_dir), "k", ["status", "odd"], asserted_only=True)


@query("transcript_sequence", "SELECT user_id AS path, event_id AS \"offset\", row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events")
def transcript_sequence(spark, sf_dir):
    return turns.transcript_sequence(_t(spark, sf_dir, "events").selectExpr("user_id AS path", "event_id AS offset"))


@query("source_recency", "SELECT *, CASE WHEN age_days <= 900 THEN 'recent' ELSE 'older' END AS recency FROM (SELECT o_orderkey AS id, CAST(round((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 86400000000.0) AS INT) AS age_days FROM orders)")
def source_recency(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(o_orderdate AS TIMESTAMP) AS mtime")
    return ledger.recency(rows, F.lit("2000-01-01").cast("timestamp"), 900).drop("mtime")

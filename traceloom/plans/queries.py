"""The operators over the driver's tables through thin adapters, and the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cost, joins, ledger, quality, search, templates, turns
from ..sources import transcripts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_TS = "%Y-%m-%d %H:%M:%S.%f"
_KIND_SQL = "CASE event_type WHEN 'signup' THEN 'user_prompt' WHEN 'error' THEN 'tool_result_error' WHEN 'purchase' THEN 'assistant_response' ELSE 'tool_decision' END"


def _facts(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "user_prompt").when(F.col("event_type") == "error", "tool_result_error").when(F.col("event_type") == "purchase", "assistant_response").otherwise("tool_decision")
    return e.select(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("ts").cast("timestamp").alias("at"), F.lit("").alias("path"), F.col("event_id").alias("seq"), kind.alias("event_type"), F.when(kind == "user_prompt", F.col("event_id")).alias("prompt_id"))


@query("turn_rollup", f"""
WITH f AS (SELECT user_id AS session_id, ts, event_id AS seq, {_KIND_SQL} AS event_type FROM events),
o AS (SELECT *, count(CASE WHEN event_type = 'user_prompt' THEN 1 END) OVER w AS turn_no,
  lag(event_type) OVER w2 AS prev_type, lag(ts) OVER w2 AS prev_ts FROM f
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY session_id ORDER BY ts, seq)),
a AS (SELECT session_id, turn_no, max(CASE WHEN event_type = 'user_prompt' THEN seq END) AS prompt_id, max(CASE WHEN event_type = 'user_prompt' THEN ts END) AS started_at, max(ts) AS ended_at,
  CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0) AS BIGINT) AS duration_ms,
  count(CASE WHEN event_type = 'tool_decision' THEN 1 END) AS tool_call_count,
  CAST(coalesce(sum(CASE WHEN event_type IN ('assistant_response', 'tool_decision') AND prev_type IN ('user_prompt', 'tool_result_error') THEN round((epoch_us(ts) - epoch_us(prev_ts)) / 1000.0) END), 0) AS BIGINT) AS thinking_ms
  FROM o WHERE turn_no > 0 GROUP BY ALL)
SELECT prompt_id, session_id, strftime(started_at, '{_TS}') AS started_at, strftime(ended_at, '{_TS}') AS ended_at, duration_ms, tool_call_count, thinking_ms,
  row_number() OVER (PARTITION BY session_id ORDER BY started_at, prompt_id) - 1 AS turn_index FROM a""")
def turn_rollup(spark, sf_dir):
    return turns.turn_rollup(_facts(spark, sf_dir), "at")


@query("phase_collapse", f"""
WITH e AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
c AS (SELECT * FROM e WHERE before IS DISTINCT FROM event_type)
SELECT user_id, lag(event_type) OVER w AS from_mode, event_type AS to_mode, strftime(ts, '{_TS}') AS t_valid, strftime(lead(ts) OVER w, '{_TS}') AS t_invalid FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def phase_collapse(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("mode"))
    return turns.phase_collapse(e, ["user_id"], ["ts", "event_id"])


@query("session_merge", f"""
SELECT user_id AS session_id, strftime(min(ts), '{_TS}') AS started_at, strftime(max(ts), '{_TS}') AS ended_at,
  arg_min(CASE WHEN event_type = 'click' THEN props END, event_id) FILTER (WHERE event_type = 'click') AS branch,
  arg_min(CASE WHEN event_type = 'signup' THEN props END, event_id) FILTER (WHERE event_type = 'signup') AS seed_prompt,
  arg_max(CASE WHEN event_type = 'view' THEN props END, event_id) FILTER (WHERE event_type = 'view') AS title,
  arg_max(CASE WHEN value > 50 THEN event_type END, event_id) FILTER (WHERE value > 50) AS cwd,
  arg_max(props, event_id) AS version,
  arg_min(CASE WHEN value > 20 THEN event_type END, ts) FILTER (WHERE value > 20) AS start_type,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) AS turn_count, count(CASE WHEN event_type = 'click' THEN 1 END) AS commit_count, count(CASE WHEN event_type = 'error' THEN 1 END) AS push_count
FROM events GROUP BY user_id""")
def session_merge(spark, sf_dir):
    e, kind = _t(spark, sf_dir, "events"), lambda k: F.col("event_type") == k
    rows = e.select(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.lit("").alias("path"), F.col("event_id").alias("offset"), F.when(kind("click"), F.col("props")).alias("branch"), F.when(kind("signup"), F.col("props")).alias("seed"), F.when(kind("view"), F.col("props")).alias("title"), F.when(F.col("value") > 50, F.col("event_type")).alias("cwd"), F.col("props").alias("version"), F.when(F.col("value") > 20, F.col("event_type")).alias("entrypoint"), kind("purchase").alias("is_assistant"), kind("click").cast("long").alias("commits"), kind("error").cast("long").alias("pushes"))
    return turns.session_merge(rows)


_USAGE = "SELECT l.l_orderkey AS session_id, p.p_brand AS model, CAST(sum(l.l_quantity) AS BIGINT) AS input, CAST(sum(round(l.l_extendedprice)) AS BIGINT) AS output, CAST(sum(l.l_linenumber) AS BIGINT) AS cache_read, count(*) AS cache_creation FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY ALL"
_RATES = "SELECT DISTINCT p_brand AS base_model, CAST(substr(p_brand, 7) AS INT) AS b FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 5 <> 0"
_PRICED = f"SELECT u.*, round((input * CAST(b AS DOUBLE) + output * CAST(b + 1 AS DOUBLE) + cache_read * CAST(2 AS DOUBLE) + cache_creation * CAST(3 AS DOUBLE)) / 1e6, 6) AS usd FROM ({_USAGE}) u LEFT JOIN ({_RATES}) r ON r.base_model = u.model"


def _priced(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    use = _t(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("session_id"), F.col("p_brand").alias("model"))
    use = use.agg(F.sum("l_quantity").cast("long").alias("input"), F.sum(F.round("l_extendedprice")).cast("long").alias("output"), F.sum("l_linenumber").cast("long").alias("cache_read"), F.count("*").alias("cache_creation"))
    b = F.expr("cast(substr(p_brand, 7) as int)")
    rates = part.select(F.col("p_brand").alias("model"), b.cast("double").alias("input"), (b + 1).cast("double").alias("output"), F.lit(2.0).alias("cache_read"), F.lit(3.0).alias("cache_creation")).distinct().filter(F.col("input").cast("int") % 5 != 0)
    return cost.priced(use, rates)


@query("usage_cost", f"SELECT session_id, model, input, output, cache_read, cache_creation, model AS base_model, usd FROM ({_PRICED})")
def usage_cost(spark, sf_dir):
    return _priced(spark, sf_dir)


@query("unpriced", f"SELECT model, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(cache_creation) AS BIGINT) AS cache_creation, count(*) AS n_rows FROM ({_PRICED}) WHERE usd IS NULL GROUP BY model")
def unpriced(spark, sf_dir):
    return cost.unpriced(_priced(spark, sf_dir))


@query("cost_by_group", f"SELECT o.o_custkey AS pr, round(sum(s.usd), 4) AS usd, count(*) AS sessions FROM (SELECT session_id, round(sum(usd), 6) AS usd FROM ({_PRICED}) GROUP BY 1) s JOIN orders o ON o.o_orderkey = s.session_id GROUP BY 1")
def cost_by_group(spark, sf_dir):
    members = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pr"), F.col("o_orderkey").alias("session_id"))
    return cost.per_group(cost.per_session(_priced(spark, sf_dir)), members, "pr").withColumn("usd", F.round("usd", 4))


_PAIRS = "WITH t AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS sessions FROM t x JOIN t y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL"


@query("co_change", _PAIRS)
def co_change(spark, sf_dir):
    return cost.co_change(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("co_change_top", f"SELECT item, other, sessions, row_number() OVER (PARTITION BY item ORDER BY sessions DESC, other) AS rank FROM (SELECT a AS item, b AS other, sessions FROM ({_PAIRS}) UNION ALL SELECT b, a, sessions FROM ({_PAIRS}))")
def co_change_top(spark, sf_dir):
    return cost.co_change_top(co_change(spark, sf_dir))


@query("percentile_nearest", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(CASE WHEN k = floor((n - 1) * 0.5::DOUBLE) + 1 THEN value END) AS p50, max(CASE WHEN k = floor((n - 1) * 0.85::DOUBLE) + 1 THEN value END) AS p85, max(CASE WHEN k = floor((n - 1) * 0.99::DOUBLE) + 1 THEN value END) AS p99 FROM r GROUP BY 1")
def percentile_nearest(spark, sf_dir):
    return turns.percentile_nearest(_t(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p85": 0.85, "p99": 0.99})


@query("pr_merge_reconcile", """
WITH p AS (SELECT 'Org/' || n.n_name AS repo, s.s_suppkey AS number FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey),
o AS (SELECT o_custkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lower(n.n_name) END AS hint, strftime(o_orderdate, '%Y-%m-%d') AS merged_at FROM orders JOIN nation n ON n.n_nationkey = o_orderkey % 25)
SELECT p.repo, p.number, CASE WHEN min(o.merged_at) IS NULL THEN 'open' ELSE 'merged' END AS state, min(o.merged_at) AS merged_at FROM p LEFT JOIN o ON o.number = p.number AND (o.hint IS NULL OR ends_with(lower(p.repo), '/' || lower(o.hint))) GROUP BY ALL""")
def pr_merge_reconcile(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    prs = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("Org/"), "n_name").alias("repo"), F.col("s_suppkey").cast("long").alias("number"), F.lit("open").alias("state"), F.lit(None).cast("string").alias("merged_at"))
    seen = _t(spark, sf_dir, "orders").join(nation, F.col("o_orderkey") % 25 == F.col("n_nationkey")).select(F.col("o_custkey").alias("number"), F.when(F.col("o_orderkey") % 3 != 0, F.lower("n_name")).alias("repo_hint"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("merged_at"))
    return joins.merge_reconcile(prs, seen)


@query("asof_price", """
WITH m AS (SELECT l_suppkey AS k, date_trunc('month', l_shipdate) AS d, CAST(max(round(l_extendedprice)) AS BIGINT) AS price FROM lineitem GROUP BY ALL)
SELECT o.o_orderkey, m.price FROM (SELECT o_orderkey, o_custkey % 100 AS k, o_orderdate FROM orders) o ASOF LEFT JOIN m ON o.k = m.k AND o.o_orderdate >= m.d""")
def asof_price(spark, sf_dir):
    prices = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("k"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("d")).agg(F.max(F.round("l_extendedprice")).cast("long").alias("price"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), "o_orderdate")
    return turns.asof(rows, "k", "o_orderdate", prices, "d", ["price"]).select("o_orderkey", "price")


@query("last_in_effect", """
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'click' THEN props END AS mark FROM events)
SELECT event_id, nullif(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS current FROM e""")
def last_in_effect(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("branch", F.when(F.col("event_type") == "click", F.col("props")))
    return turns.last_in_effect(e, "user_id", ["ts", "event_id"], "branch", F.col("event_type") == "error").select("event_id", "current")


_EDGES = "SELECT 'session:' || user_id AS source_ref, 'touched' AS relation, 'file:' || event_type AS target_ref, event_id AS ord FROM events UNION ALL SELECT 'customer:' || c_custkey, 'linked', 'nation:' || (c_nationkey + 2), c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'linked', 'nation:' || s_nationkey, s_suppkey FROM supplier"


def _edges(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.concat(F.lit("session:"), F.col("user_id").cast("string")).alias("source_ref"), F.lit("touched").alias("relation"), F.concat(F.lit("file:"), "event_type").alias("target_ref"), F.col("event_id").cast("long").alias("ord"))
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.lit("linked"), F.concat(F.lit("nation:"), (F.col("c_nationkey") + 2).cast("string")), F.col("c_custkey").cast("long"))
    s = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), F.lit("linked"), F.concat(F.lit("nation:"), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("long"))
    return e.union(c).union(s)


@query("edges_dedupe", f"SELECT source_ref, relation, target_ref, CAST(min(ord) AS BIGINT) AS ord FROM ({_EDGES}) GROUP BY ALL")
def edges_dedupe(spark, sf_dir):
    return turns.dedupe_edges(_edges(spark, sf_dir), ["ord"])


@query("edge_liveness", f"SELECT relation, coalesce(n, 0) AS n, coalesce(declared, false) AS declared FROM (SELECT relation, count(*) AS n FROM ({_EDGES}) GROUP BY 1) FULL JOIN (SELECT unnest(['touched', 'worked', 'ran']) AS relation, true AS declared) USING (relation)")
def edge_liveness(spark, sf_dir):
    return quality.relation_liveness(spark, _edges(spark, sf_dir), ["touched", "worked", "ran"])


@query("dangling_refs", f"""
WITH ends AS (SELECT source_ref AS ref FROM ({_EDGES}) UNION ALL SELECT target_ref FROM ({_EDGES})),
known AS (SELECT DISTINCT 'session:' || user_id AS ref FROM events WHERE event_type = 'signup' UNION SELECT 'customer:' || c_custkey FROM customer UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT split_part(e.ref, ':', 1) AS namespace, count(*) AS edges, count(*) FILTER (WHERE k.ref IS NULL) AS dangling FROM ends e LEFT JOIN known k ON k.ref = e.ref GROUP BY 1""")
def dangling_refs(spark, sf_dir):
    known = {"session": (_t(spark, sf_dir, "events").filter("event_type = 'signup'"), "user_id"), "customer": (_t(spark, sf_dir, "customer"), "c_custkey"), "nation": (_t(spark, sf_dir, "nation"), "n_nationkey"), "supplier": (_t(spark, sf_dir, "supplier").filter("s_acctbal > 0"), "s_suppkey")}
    return joins.dangling(_edges(spark, sf_dir), known)


@query("column_liveness", "SELECT 'events' AS table_name, count(*) AS rows, unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS \"column\", unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value), count(props)]) AS non_null FROM events")
def column_liveness(spark, sf_dir):
    return quality.column_liveness(_t(spark, sf_dir, "events"), "events")


@query("precision_coverage", """
WITH r AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 1000), t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT reported, truth, hits, round(hits / reported, 4) AS precision, round(hits / truth, 4) AS coverage FROM (SELECT (SELECT count(*) FROM r) AS reported, (SELECT count(*) FROM t) AS truth, (SELECT count(*) FROM r SEMI JOIN t USING (doc_id)) AS hits)""")
def precision_coverage(spark, sf_dir):
    return quality.precision_coverage(_t(spark, sf_dir, "documents").filter("n_chars > 1000"), _t(spark, sf_dir, "labels").filter("quality = 1"), "doc_id")


_DIGESTED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query("table_digest", "WITH d AS (SELECT sha256(" + " || chr(31) || ".join(f"'=' || {c}" for c in _DIGESTED) + ") AS d FROM orders) SELECT count(*) AS rows, " + ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR) AS s{i}" for i in range(4)) + " FROM d")
def table_digest(spark, sf_dir):
    return quality.table_digest(_t(spark, sf_dir, "orders"), _DIGESTED)


@query("set_divergence", """
WITH x AS (SELECT DISTINCT l_orderkey || ':' || l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A'), y AS (SELECT DISTINCT l_orderkey || ':' || l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT size_a, size_b, differ, round(differ / (size_a + size_b), 6) AS divergence FROM (SELECT (SELECT count(*) FROM x) AS size_a, (SELECT count(*) FROM y) AS size_b, (SELECT count(*) FROM x FULL JOIN y ON x.k = y.k WHERE x.k IS NULL OR y.k IS NULL) AS differ)""")
def set_divergence(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("k"), "l_returnflag")
    return quality.set_divergence(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"), "k")


@query("median_by", "SELECT o_orderpriority AS kind, median(o_totalprice) AS median, count(*) AS n FROM orders GROUP BY 1")
def median_by(spark, sf_dir):
    return turns.median(_t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("value")), "kind", "value")


@query("cost_ranking", "SELECT * FROM (SELECT o_custkey AS k, sum(o_totalprice) AS cost, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS place FROM orders GROUP BY 1) WHERE place <= 10")
def cost_ranking(spark, sf_dir):
    return cost.ranking(_t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("cost")), "k", "cost")


@query("line_locators", r"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts[:-2]) AS text, unnest(range(len(parts) - 1)) AS line_no FROM p)
SELECT doc_id, line_no, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", strlen(text) AS length, text FROM l""")
def line_locators(spark, sf_dir):
    return transcripts.text_lines(_t(spark, sf_dir, "documents"), "doc_id", "text")


def _blobs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "test").when(F.col("doc_id") % 3 == 1, "Bash").otherwise("generic").alias("tool_type"), F.col("text").alias("raw_text"), F.lit(False).alias("is_error"))


@query("signature", r"""
WITH l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'Bash' ELSE 'generic' END AS tool, string_split(text, chr(10)) AS lines FROM documents),
a AS (SELECT doc_id, list_filter(lines, lambda x: trim(x) <> '') AS blank,
 coalesce(CASE WHEN tool = 'test' THEN coalesce(list_filter(lines, lambda x: regexp_matches(x, '(?i)[0-9]+\s+passed.*[0-9]+\s+failed'))[1], list_filter(lines, lambda x: regexp_matches(x, '(?i)[0-9]+\s+failed.*[0-9]+\s+passed'))[1], list_filter(lines, lambda x: regexp_matches(x, 'error TS[0-9]+:.*$'))[1], list_filter(lines, lambda x: regexp_matches(x, '^\s*✖?\s*[A-Za-z0-9_-]+/[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*\s*$'))[1]) END,
  list_filter(lines, lambda x: regexp_matches(x, '^[A-Za-z0-9_]*Error\b.*$'))[1], list_filter(lines, lambda x: regexp_matches(x, '^\s*at\s.*$'))[1], list_filter(lines, lambda x: regexp_matches(x, '(?i)exit (?:code|status)[: ]+[0-9]+'))[1]) AS found FROM l),
b AS (SELECT doc_id, trim(coalesce(found, blank[-1], '')) AS anchor, found IS NOT NULL AS anchored, CASE WHEN len(blank) = 0 THEN '0' WHEN len(blank) = 1 THEN '1' WHEN len(blank) <= 5 THEN '2-5' ELSE '6+' END AS bucket FROM a)
SELECT doc_id, anchored, bucket, anchor, coalesce(nullif(regexp_extract(anchor, '^([A-Za-z0-9_]*Error)\b', 1), ''), nullif(regexp_extract(anchor, 'error (TS[0-9]+):', 1), ''), nullif(regexp_extract(anchor, '^([A-Za-z0-9_-]+/[A-Za-z0-9_-]+(?:/[A-Za-z0-9_-]+)*)\s*$', 1), ''), 'unknown') AS error_class FROM b""")
def signature(spark, sf_dir):
    b = _blobs(spark, sf_dir).select("doc_id", X.signature(F.col("tool_type"), F.col("raw_text")).alias("s"))
    return b.select("doc_id", "s.anchored", "s.bucket", "s.anchor", "s.error_class")


@query("mask", r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(u, '(?:\.{0,2}/)?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+', '<PATH>', 'g'), ':[0-9]+:[0-9]+\b', '<LINENO>', 'g'), '[0-9]+', '<NUM>', 'g') AS masked
FROM (SELECT page_id, regexp_replace(url, '(?i)\b[0-9a-f]{7,40}\b', '<SHA>', 'g') AS u FROM pages)""")
def mask(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", X.mask(F.col("url")).alias("masked"))


#: Documents of a partition where each costs much more than reading it.
DEALT_DOCS = 1000


def _assigned(spark, sf_dir):
    # every line of every document, in the order of documents and lines
    lines = joins.dealt(_t(spark, sf_dir, "documents"), "doc_id", each=DEALT_DOCS).select("doc_id", F.col("source").alias("tool_type"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("trim(line) <> ''")
    return templates.drain(lines.select("tool_type", X.mask(F.col("line")).alias("masked"), (F.shiftleft("doc_id", 24) + F.col("line_no")).alias("arrival")))


@query("drain_templates")
def drain_templates(spark, sf_dir):
    return templates.templates(_assigned(spark, sf_dir), 5000)


@query("template_support")
def template_support(spark, sf_dir):
    return templates.support(templates.templates(_assigned(spark, sf_dir)))


_TOKENS = r"SELECT doc_id AS span_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+'))) AS token FROM documents"


@query("search_match", f"""
WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'))) AS token FROM benchmark), k AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1), t AS ({_TOKENS})
SELECT query_id, span_id FROM q JOIN t USING (token) JOIN k USING (query_id) GROUP BY query_id, span_id, k HAVING count(*) = k""")
def search_match(spark, sf_dir):
    spans = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("span_id"), F.lit("text").alias("field"), "text")
    return search.match_queries(search.index_spans(spans), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("longest_prefix", r"""
WITH roots AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS root, 'host' AS name FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/?]+)', 1), 'folder' FROM pages WHERE page_id % 2 = 0),
m AS (SELECT p.page_id, r.root, r.name, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.root) DESC) AS k FROM pages p JOIN roots r ON p.url = r.root OR starts_with(p.url, r.root || '/'))
SELECT p.page_id, m.root, m.name, regexp_replace(substr(p.url, length(m.root) + 1), '^/', '') AS rest FROM pages p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1""")
def longest_prefix(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", "url")
    host = p.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root"), F.lit("host").alias("name")).distinct()
    folder = p.filter("page_id % 2 = 0").select(F.regexp_extract("url", "^(https?://[^/]+/[^/?]+)", 1).alias("root"), F.lit("folder").alias("name")).distinct()
    return joins.longest_prefix(p, "url", host.union(folder), ["page_id"]).select("page_id", "root", "name", "rest")


@query("git_intent", r"""
WITH c AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'git checkout -b feat/u' || user_id || ' main' WHEN 'click' THEN 'cd /w/r' || user_id || ' && git commit -m x && git push origin fix-' || user_id WHEN 'error' THEN 'git branch -D old/' || user_id WHEN 'purchase' THEN 'gh pr merge ' || user_id || ' --squash' ELSE 'ls -la ' || user_id END AS command, event_type, user_id FROM events)
SELECT event_id, CASE event_type WHEN 'signup' THEN 'feat/u' || user_id WHEN 'click' THEN 'fix-' || user_id END AS set_branch, CASE event_type WHEN 'signup' THEN 'main' END AS branch_base, CASE event_type WHEN 'error' THEN 'old/' || user_id END AS deleted_branch, CASE event_type WHEN 'purchase' THEN user_id END AS merged_pr, CASE WHEN event_type <> 'view' THEN event_type = 'click' END AS "commit", CASE WHEN event_type <> 'view' THEN event_type = 'click' END AS push FROM c""")
def git_intent(spark, sf_dir):
    u = F.col("user_id").cast("string")
    kind = F.col("event_type")
    command = F.when(kind == "signup", F.concat(F.lit("git checkout -b feat/u"), u, F.lit(" main"))).when(kind == "click", F.concat(F.lit("cd /w/r"), u, F.lit(" && git commit -m x && git push origin fix-"), u)).when(kind == "error", F.concat(F.lit("git branch -D old/"), u)).when(kind == "purchase", F.concat(F.lit("gh pr merge "), u, F.lit(" --squash"))).otherwise(F.concat(F.lit("ls -la "), u))
    return _t(spark, sf_dir, "events").select("event_id", X.git_intent(command).alias("i")).select("event_id", "i.*")


_LOOPS = "SELECT o_custkey % 7 AS slug, 'f' || l_orderkey AS file, 's' || o_custkey AS session_id, o_orderdate AS ended, 'f' || l_orderkey || '#' || l_linenumber AS ref FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A') JOIN orders ON o_orderkey = l_orderkey"
_RESOLVES = f"""SELECT r.slug, r.ref, r.by_file, r.by_ended, r.outcome, CASE WHEN split_part(r.ref, '#', 1) = r.by_file THEN 'self' WHEN o.file IS NULL THEN 'missing' WHEN o.session_id = r.by_session THEN 'self' WHEN o.ended >= r.by_ended THEN 'not-prior' END AS problem
FROM (SELECT o_custkey % 7 AS slug, 'f' || (l_orderkey - l_orderkey % 10) || '#' || l_linenumber AS ref, 'f' || l_orderkey AS by_file, 's' || o_custkey AS by_session, o_orderdate AS by_ended, CASE WHEN l_linestatus = 'O' THEN 'done' ELSE 'abandoned' END AS outcome FROM (SELECT l_orderkey, l_linenumber, max(l_linestatus) AS l_linestatus FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey) r LEFT JOIN ({_LOOPS}) o ON o.slug = r.slug AND o.ref = r.ref"""


def _ledger(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    s = lambda c: F.col(c).cast("string")
    item = _t(spark, sf_dir, "lineitem")
    steps = item.filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda n: F.struct(n.cast("string").alias("id"), F.lit("").alias("text"), F.lit("task").alias("kind"), F.lit(None).cast("string").alias("ref"))).alias("next_steps"))
    one = item.filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("st"))
    res = one.groupBy(F.col("l_orderkey").alias("rk")).agg(F.collect_list(F.struct(F.concat(F.lit("f"), (F.col("l_orderkey") - F.col("l_orderkey") % 10).cast("string"), F.lit("#"), s("l_linenumber")).alias("ref"), F.when(F.col("st") == "O", "done").otherwise("abandoned").alias("outcome"), F.lit(None).cast("string").alias("note"))).alias("resolves"))
    docs = o.join(steps, o.o_orderkey == steps.l_orderkey, "left").join(res, o.o_orderkey == res.rk, "left").select((F.col("o_custkey") % 7).alias("slug"), F.concat(F.lit("f"), s("o_orderkey")).alias("file"), F.concat(F.lit("s"), s("o_custkey")).alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("ended"), "next_steps", "resolves")
    opened = ledger.loops(docs)
    return opened, ledger.resolves(docs, opened)


@query("open_ledger", f"SELECT slug, ref, CAST(greatest(0, date_diff('day', ended, TIMESTAMP '2002-01-01')) AS INT) AS age_days FROM ({_LOOPS}) l WHERE NOT EXISTS (SELECT 1 FROM ({_RESOLVES}) r WHERE r.problem IS NULL AND r.slug = l.slug AND r.ref = l.ref)")
def open_ledger(spark, sf_dir):
    opened, found = _ledger(spark, sf_dir)
    return ledger.open_ledger(opened, ledger.latest_resolution(found), F.lit("2002-01-01").cast("timestamp")).select("slug", "ref", "age_days")


@query("resolved_ledger", f"SELECT slug, ref, by_file, outcome FROM (SELECT *, row_number() OVER (PARTITION BY slug, ref ORDER BY by_ended DESC, by_file DESC) AS k FROM ({_RESOLVES}) WHERE problem IS NULL) WHERE k = 1")
def resolved_ledger(spark, sf_dir):
    opened, found = _ledger(spark, sf_dir)
    return ledger.resolved_ledger(opened, ledger.latest_resolution(found)).select("slug", "ref", "by_file", "outcome")


@query("dangling_resolves", f"SELECT slug, problem, count(*) AS n FROM ({_RESOLVES}) WHERE problem IS NOT NULL GROUP BY ALL")
def dangling_resolves(spark, sf_dir):
    return ledger.dangling_report(_ledger(spark, sf_dir)[1]).drop("refs")


@query("rank_shift", "SELECT s_suppkey AS id, CAST(s_suppkey AS INT) AS old_rank, CAST(CASE WHEN s_suppkey = 5 THEN 3 ELSE s_suppkey + 1 END AS INT) AS new_rank FROM supplier WHERE s_suppkey = 5 OR s_suppkey >= 3")
def rank_shift(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("int").alias("r"))
    return turns.dense_rerank(s, "id", "r", (5, 3))


@query("conv_turns", """
WITH f AS (SELECT *, count(CASE WHEN role = 'user' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn_no FROM conversations)
SELECT conv_id, turn_no, count(*) AS messages, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers, arg_min(left(text, 150), turn) AS summary FROM f GROUP BY ALL""")
def conv_turns(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    f = turns.ordered_facts(c.select(F.col("conv_id").alias("session_id"), F.lit("").alias("ts"), F.lit("").alias("path"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "user_prompt").otherwise(F.col("role")).alias("event_type"), "text"))
    return f.groupBy(F.col("session_id").alias("conv_id"), "turn_no").agg(F.count("*").alias("messages"), F.count(F.when(F.col("event_type") == "assistant", 1)).alias("answers"), F.min_by(F.left("text", F.lit(150)), "seq").alias("summary"))


@query("subagent_tree", """
WITH RECURSIVE l AS (SELECT DISTINCT conv_id AS id, CASE WHEN conv_id > 0 THEN conv_id // 2 END AS parent FROM conversations),
t AS (SELECT id, id AS root, 0 AS depth, CAST(id AS VARCHAR) AS path FROM l WHERE parent IS NULL UNION ALL SELECT l.id, t.root, t.depth + 1, t.path || '/' || l.id FROM t JOIN l ON l.parent = t.id)
SELECT id, root, depth, path FROM t""")
def subagent_tree(spark, sf_dir):
    links = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") > 0, F.floor(F.col("conv_id") / 2)).alias("parent")).distinct()
    return joins.subagent_tree(spark, links)


@query("stale_and_top", "SELECT slug, id, priority, CAST(rank AS INT) AS rank, open_tasks FROM (SELECT c_nationkey AS slug, c_custkey AS id, c_acctbal AS priority, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rank, count(*) OVER (PARTITION BY c_nationkey) AS open_tasks FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE rank <= 5")
def stale_and_top(spark, sf_dir):
    t = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("slug"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("priority"), F.when(F.col("c_mktsegment") == "BUILDING", "done").otherwise("open").alias("status"))
    return ledger.top_tasks(t).select("slug", "id", "priority", "rank", "open_tasks")


@query("pr_sessions", "SELECT o_orderkey AS pr, o_custkey AS session_id FROM orders UNION SELECT o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'")
def pr_sessions(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    links = o.select(F.col("o_orderkey").alias("pr"), F.col("o_custkey").alias("session_id"))
    prs = o.select(F.col("o_orderkey").alias("pr"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("branch"))
    return joins.pr_sessions(links, prs, _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("branch"), F.col("l_suppkey").alias("session_id")))

"""Text rules, the ledger's checks, workspace listings and gates over the driver's tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import ledger, quality, templates
from ..streaming import incremental
from .queries import ORACLE_SQL, _blobs, _t, query

_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("text_labels", rf"""
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug,
  CASE WHEN length({_FLAT}) > 80 THEN left({_FLAT}, 79) || '…' ELSE {_FLAT} END AS short,
  CASE WHEN regexp_replace(text, '\s+$', '') = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\s+$', ''), chr(10))) END AS lines FROM documents""")
def text_labels(spark, sf_dir):
    t = F.col("text")
    return _t(spark, sf_dir, "documents").select("doc_id", X.slug(t).alias("slug"), X.truncate(t, 80).alias("short"), X.body_lines(t).cast("long").alias("lines"))


_BODY = "repeat('plain' || chr(10), doc_id % 250) || CASE WHEN doc_id % 3 = 0 THEN '#none' ELSE '## Head ' || doc_id || '  ' END || chr(10) || text"


@query("first_headings", rf"""
SELECT doc_id, nullif(regexp_extract(array_to_string(list_slice(string_split({_BODY}, chr(10)), 1, 200), chr(10)), '(?m)^#{{1,6}}\s+(.+?)\s*$', 1), '') AS heading,
  CASE doc_id % 4 WHEN 0 THEN 'pr' WHEN 1 THEN 'deepdive' WHEN 2 THEN 'session' ELSE 'pointer' END AS kind FROM documents""")
def first_headings(spark, sf_dir):
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'pr-' || doc_id || '-x.md' WHEN 1 THEN 'deepdive-' || doc_id WHEN 2 THEN '2026-01-02-' || doc_id ELSE 'xpr-' || doc_id || '-' END")
    body = F.expr(_BODY.replace("chr(10)", "'\\n'").replace("doc_id % 250", "cast(doc_id % 250 as int)"))
    return _t(spark, sf_dir, "documents").select("doc_id", X.first_heading(body).alias("heading"), X.source_type(name).alias("kind"))


_LINKED = "'[x](sources/' || replace(p_name, ' ', '-') || ') [y](./sources/' || p_brand || '#top) [z](sources/' || p_brand || ') [n](other/' || p_partkey || ')'"


@query("source_links", rf"SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all({_LINKED}, '\]\((?:\./)?sources/([^)\s#]+)', 1))), ',') AS links FROM part")
def source_links(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(X.source_links(F.expr(_LINKED)), ",").alias("links"))


_STAMP = "CASE o_orderkey % 6 WHEN 0 THEN '1995-0' || o_orderkey % 9 || '-1' || o_orderkey % 10 WHEN 1 THEN '1995-13-02' WHEN 2 THEN '1996-02-2' || o_orderkey % 10 || 'T0' || o_orderkey % 10 || ':04:05Z' WHEN 3 THEN '1995-01-02T25:00:00Z' WHEN 4 THEN '1995-1-2' ELSE '1995-01-02T03:04:05' END"


@query("date_validity", rf"""
WITH s AS (SELECT o_orderkey, {_STAMP} AS v FROM orders)
SELECT o_orderkey, regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast(v AS DATE) IS NOT NULL AS is_date, regexp_full_match(v, '[0-9-]{{10}}T[0-9:]{{8}}Z') AND try_strptime(v, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AS is_instant FROM s""")
def date_validity(spark, sf_dir):
    v = F.expr(_STAMP)
    return _t(spark, sf_dir, "orders").select("o_orderkey", X.is_date(v).alias("is_date"), X.is_instant(v).alias("is_instant"))


@query("pr_numbers", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS number, 'pr:o/r#' || o_orderkey AS pr_ref, 'file:' || CASE WHEN o_custkey % 2 = 0 THEN 'o/r/' ELSE '' END || o_clerk AS file_ref, sha256('Bash' || chr(0) || o_clerk) AS template FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM orders)")
def pr_numbers(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("#"), k)).when(F.col("o_orderkey") % 3 == 1, k).otherwise(F.concat(F.lit("https://github.com/o/r/pull/"), k, F.lit("/files")))
    clerk = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", X.pr_number(said).alias("number"), X.pr_ref(F.lit("o/r"), F.col("o_orderkey")).alias("pr_ref"), X.file_ref(F.when(F.col("o_custkey") % 2 == 0, F.lit("o/r")), clerk).alias("file_ref"), X.template_id(F.lit("Bash"), clerk).alias("template"))


_JSON = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k": "s' || user_id || '"}' WHEN 2 THEN '{"k": ' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || '}' WHEN 3 THEN '{"k": ""}' WHEN 4 THEN '{"k": [1]}' ELSE '{}' END"""


@query("json_access", f"""
WITH j AS (SELECT event_id, {_JSON} AS j FROM events)
SELECT event_id, CASE WHEN json_type(j, '$.k') = 'VARCHAR' THEN nullif(json_extract_string(j, '$.k'), '') END AS s, CASE WHEN json_type(j, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract_string(j, '$.k') AS BIGINT) ELSE 0 END AS n, coalesce(json_type(j, '$.k') = 'BOOLEAN' AND json_extract_string(j, '$.k') = 'true', false) AS b FROM j""")
def json_access(spark, sf_dir):
    v = F.col("v")
    return _t(spark, sf_dir, "events").select("event_id", F.parse_json(F.expr(_JSON)).alias("v")).select("event_id", X.json_str(v, "$.k").alias("s"), X.json_num(v, "$.k").alias("n"), X.json_bool(v, "$.k").alias("b"))


_TYPED = "CASE c_custkey % 5 WHEN 0 THEN '  cd /w/a && cd b; ls   -l ' || c_custkey WHEN 1 THEN 'git -C /w/x' || c_custkey || ' status' WHEN 2 THEN 'cd sub/../lib && make' WHEN 3 THEN 'cd ~/p' || c_custkey || ' && ls' ELSE 'ls .' END"


@query("shell_text", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ls   -l ' || c_custkey WHEN 1 THEN 'git -C /w/x' || c_custkey || ' status' WHEN 2 THEN 'make' WHEN 3 THEN 'ls' ELSE 'ls .' END AS command,
  CASE c_custkey % 5 WHEN 0 THEN 'ls|-l|' || c_custkey WHEN 1 THEN 'git|-C|/w/x' || c_custkey || '|status' WHEN 2 THEN 'make' WHEN 3 THEN 'ls' ELSE 'ls|.' END AS tokens,
  CASE c_custkey % 5 WHEN 0 THEN '/w/a' WHEN 1 THEN '/w/x' || c_custkey WHEN 2 THEN '/home/lib' WHEN 3 THEN '~/p' || c_custkey ELSE '/home' END AS folder FROM customer""")
def shell_text(spark, sf_dir):
    raw = F.expr(_TYPED)
    return _t(spark, sf_dir, "customer").select("c_custkey", X.real_command(raw).alias("command"), F.array_join(X.tokens(X.real_command(raw)), "|").alias("tokens"), X.command_dir(raw, F.lit("/home")).alias("folder"))


@query("tool_types", "SELECT event_type, CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'Read' WHEN 'error' THEN 'Edit' ELSE 'generic' END AS tool_type, count(*) AS n FROM events GROUP BY ALL")
def tool_types(spark, sf_dir):
    name = F.create_map(*[F.lit(x) for x in ("click", "Bash", "view", "Read", "error", "MultiEdit", "signup", "Grep", "purchase", "Write")])
    return _t(spark, sf_dir, "events").groupBy("event_type", X.tool_type(F.try_element_at(name, F.col("event_type"))).alias("tool_type")).agg(F.count("*").alias("n"))


_SHA = r"'(?i)\b[0-9a-f]{7,40}\b'"
_PATH = r"'(?:\.{0,2}/)?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+'"


@query("mask_parameters", rf"""
SELECT page_id, nullif(regexp_extract(url, {_SHA}), '') AS sha, nullif(regexp_extract(u, {_PATH}), '') AS path, nullif(regexp_extract(regexp_replace(regexp_replace(u, {_PATH}, '<PATH>', 'g'), ':[0-9]+:[0-9]+\b', '<LINENO>', 'g'), '[0-9]+'), '') AS num
FROM (SELECT page_id, url, regexp_replace(url, {_SHA}, '<SHA>', 'g') AS u FROM pages)""")
def mask_parameters(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", X.mask_params(F.col("url")).alias("m"))
    return p.select("page_id", *[F.try_element_at("m", F.lit(k)).alias(k.lower()) for k in ("SHA", "PATH", "NUM")])


@query("growth_curve", """
WITH f AS (SELECT user_id AS tool_type, event_id, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1 AS is_first FROM events),
r AS (SELECT tool_type, row_number() OVER w AS blobs, CAST(sum(CAST(is_first AS INT)) OVER w AS BIGINT) AS templates FROM f WINDOW w AS (PARTITION BY tool_type ORDER BY event_id))
SELECT * FROM r WHERE blobs % 10 = 0""")
def growth_curve(spark, sf_dir):
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "events").withColumn("is_first", F.row_number().over(Window.partitionBy("user_id", "props").orderBy("event_id")) == 1)
    return templates.growth_curve(e.select(F.col("user_id").alias("tool_type"), F.col("event_id").alias("arrival"), "is_first"), 10)


@query("template_stability", """
WITH f AS (SELECT event_id, row_number() OVER (PARTITION BY props, user_id % 9 ORDER BY event_id) = 1 AS is_first FROM events), r AS (SELECT row_number() OVER (ORDER BY event_id) AS blobs, sum(CAST(is_first AS INT)) OVER (ORDER BY event_id) AS templates FROM f),
s AS (SELECT * FROM r WHERE blobs % 50 = 0), h AS (SELECT max(blobs) AS e, max(templates) AS a FROM s), m AS (SELECT max(blobs) AS b, max(templates) AS t FROM s, h WHERE blobs <= e / 2)
SELECT round(t / b, 6) AS first_rate, round((a - t) / (e - b), 6) AS second_rate, round(((a - t) / (e - b)) / (t / b), 4) AS ratio FROM h, m""")
def template_stability(spark, sf_dir):
    from pyspark.sql import Window

    e = _t(spark, sf_dir, "events").withColumn("is_first", F.row_number().over(Window.partitionBy("props", F.col("user_id") % 9).orderBy("event_id")) == 1)
    curve = templates.growth_curve(e.select(F.lit("all").alias("tool_type"), F.col("event_id").alias("arrival"), "is_first"), 50)
    return quality.stability(curve.withColumn("evicting", F.lit(False)))


@query("false_merges", """
WITH m AS (SELECT user_id AS template_id, event_id, event_type FROM events), t AS (SELECT template_id FROM m GROUP BY 1 ORDER BY count(*) DESC, template_id LIMIT 40),
s AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY event_id) AS n FROM m WHERE template_id IN (FROM t))
SELECT template_id, count(DISTINCT event_type) AS classes, count(DISTINCT event_type) > 1 AS false_merge FROM s WHERE n <= 25 GROUP BY 1""")
def false_merges(spark, sf_dir):
    return quality.false_merges(_t(spark, sf_dir, "events").select(F.col("user_id").alias("template_id"), F.col("event_id").alias("arrival"), F.col("event_type").alias("error_class")))


@query("gates", "SELECT 'rows' AS name, CAST(count(*) AS DOUBLE) AS value, CAST(1.0 AS DOUBLE) AS threshold, true AS at_least, count(*) >= 1 AS pass FROM events UNION ALL SELECT 'errors', count(CASE WHEN event_type = 'error' THEN 1 END) / count(*), CAST(0.01 AS DOUBLE), false, count(CASE WHEN event_type = 'error' THEN 1 END) / count(*) <= 0.01 FROM events")
def gates(spark, sf_dir):
    n = _t(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors")).first()
    return quality.gates(spark, [("rows", float(n["n"]), 1.0, True), ("errors", n["errors"] / n["n"], 0.01, False)])


@query("union_truth", "SELECT l_partkey AS file FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier")
def union_truth(spark, sf_dir):
    return quality.union_truth(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file")), _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("file")), _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file")))


@query("builds_agree", "SELECT 'events' AS table_name, CAST(3 AS BIGINT) AS builds, CAST(1 AS BIGINT) AS digests, true AS equal UNION ALL SELECT 'orders', 3, CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) > 0 THEN 2 ELSE 1 END, (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) = 0")
def builds_agree(spark, sf_dir):
    e, o = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    builds = {"full": {"events": e, "orders": o}, "incremental": {"events": e.filter("event_id % 2 = 0").union(e.filter("event_id % 2 = 1")), "orders": o.filter("o_orderkey % 97 <> 0")}, "rotated": {"events": e.repartition(3, "user_id"), "orders": o}}
    return quality.builds_agree(builds, {"events": ["event_id", "user_id", "event_type", "props"], "orders": ["o_orderkey", "o_custkey"]})


@query("liveness", """
SELECT 'empty_column' AS finding, 'sessions.note' AS subject, count(*) AS n, CAST(NULL AS VARCHAR) AS reason FROM customer UNION ALL SELECT 'expected_empty', 'edges.t_invalid', count(*), 'null means current; no edge is ever replaced in place' FROM orders
UNION ALL SELECT 'dead_relation', 'ran', 0, NULL UNION ALL SELECT 'undeclared_relation', o_orderstatus, count(*), NULL FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus
UNION ALL SELECT 'unmapped_namespace', 'zone', count(*), NULL FROM orders UNION ALL SELECT * FROM (SELECT 'dangling_ref', 'session', count(*) AS n, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')) WHERE n > 0""")
def liveness(spark, sf_dir):
    edges = _t(spark, sf_dir, "orders").selectExpr("'session:' || o_custkey AS source_ref", "o_orderstatus AS relation", "'zone:' || o_orderkey AS target_ref", "cast(null AS string) AS t_invalid")
    sessions = _t(spark, sf_dir, "customer").selectExpr("CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS session_id", "cast(null AS string) AS note")
    return quality.liveness_report({"edges": edges, "sessions": sessions}, ["F", "ran"], {"session": ("sessions", "session_id")})


@query("unchanged_files", "SELECT o_orderkey AS path FROM orders WHERE NOT (o_orderstatus = 'O' AND o_custkey % 5 <> 0)")
def unchanged_files(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    listed = o.selectExpr("o_orderkey AS path", "o_custkey AS length", "o_orderdate AS mtime")
    recorded = o.selectExpr("o_orderkey AS path", "CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE o_custkey END AS size", "o_orderdate AS mtime", "CASE WHEN o_orderstatus = 'O' THEN 'ok' ELSE 'quarantined' END AS status")
    return incremental.unchanged_skip(listed, recorded).select("path")


@query("bad_task_refs", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey % 7 = o_orderkey % 7)")
def bad_task_refs(spark, sf_dir):
    loops = _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 7 AS slug", "CASE WHEN o_orderstatus = 'O' THEN 'task' ELSE 'note' END AS kind", "o_custkey AS target")
    return ledger.bad_task_refs(loops, _t(spark, sf_dir, "customer").selectExpr("c_nationkey % 7 AS slug", "c_custkey AS id")).select("id")


@query("empty_ledgers", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_custkey % 5 <> 0 AND o_orderstatus = 'F'")
def empty_ledgers(spark, sf_dir):
    s = _t(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 > 0 THEN array('a') WHEN o_custkey % 2 = 0 THEN cast(array() AS array<string>) END AS next_steps", "CASE WHEN o_orderkey % 2 > 0 THEN array('b') END AS resolves", "CASE WHEN o_custkey % 5 = 0 THEN true WHEN o_custkey % 3 = 0 THEN false END AS no_loops", "CASE WHEN o_orderstatus = 'F' THEN 'canonical' ELSE 'parallel' END AS track")
    return ledger.empty_ledgers(s).select("id")


@query("long_texts", r"SELECT doc_id, len(string_split(regexp_replace(text, '\s+$', ''), chr(10))) AS lines FROM documents WHERE regexp_replace(text, '\s+$', '') <> '' AND len(string_split(regexp_replace(text, '\s+$', ''), chr(10))) > 10")
def long_texts(spark, sf_dir):
    return ledger.long_texts(_t(spark, sf_dir, "documents"), "text", 10).select("doc_id", F.col("lines").cast("long").alias("lines"))


@query("source_drift", """
WITH named AS (SELECT DISTINCT o_custkey % 50 AS slug, 'f' || o_orderkey % 40 AS name FROM orders WHERE o_orderkey % 3 = 0), files AS (SELECT DISTINCT o_custkey % 60 AS slug, 'f' || o_orderkey % 40 AS name FROM orders WHERE o_orderkey % 2 = 0)
SELECT slug, name, 'absent' AS drift FROM named WHERE (slug, name) NOT IN (SELECT (slug, name) FROM files) UNION ALL SELECT slug, name, 'unreferenced' FROM files WHERE slug IN (SELECT slug FROM named) AND (slug, name) NOT IN (SELECT (slug, name) FROM named)""")
def source_drift(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    briefs = o.filter("o_orderkey % 3 = 0").selectExpr("o_custkey % 50 AS slug", "'see [a](sources/f' || o_orderkey % 40 || ')' AS body")
    return ledger.source_drift(briefs, o.filter("o_orderkey % 2 = 0").selectExpr("o_custkey % 60 AS slug", "'f' || o_orderkey % 40 AS name"))


@query("hash_drift", "SELECT doc_id AS path, sha256(text || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE '' END) AS sha256, sha256(text) AS now FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 > 0")
def hash_drift(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    manifest = d.select(F.col("doc_id").alias("path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "x").otherwise("")), 256).alias("sha256"))
    return ledger.hash_drift(manifest, d.filter("doc_id % 3 > 0").select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("source_listing", "SELECT slug, path, kind AS type, title FROM (SELECT c_nationkey AS slug, CASE c_custkey % 3 WHEN 0 THEN 'a/pr-' || c_custkey || '-t.md' WHEN 1 THEN 'a/deepdive-' || c_custkey || '.md' ELSE 'a/n' || c_custkey || '.md' END AS path, CASE c_custkey % 3 WHEN 0 THEN 'pr' WHEN 1 THEN 'deepdive' ELSE 'pointer' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CASE c_custkey % 3 WHEN 0 THEN 'pr-' || c_custkey || '-t' WHEN 1 THEN 'deepdive-' || c_custkey ELSE 'n' || c_custkey END END AS title FROM customer) WHERE kind <> 'pointer' OR true")
def source_listing(spark, sf_dir):
    path = "CASE c_custkey % 3 WHEN 0 THEN 'a/pr-' || c_custkey || '-t.md' WHEN 1 THEN 'a/deepdive-' || c_custkey || '.md' ELSE 'a/n' || c_custkey || '.md' END AS path"
    return ledger.source_listing(_t(spark, sf_dir, "customer").selectExpr("c_nationkey AS slug", path, "CASE WHEN c_custkey % 2 = 0 THEN 'text\\n# ' || c_name || ' \\nmore' ELSE 'none' END AS body"))


@query("initiative_artifacts", "SELECT c_custkey AS slug, 'branch' AS kind, 'r' || c_nationkey AS repo, 'b' || c_custkey AS name, c_mktsegment AS note FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'worktree', 'r' || c_nationkey, '/w/' || c_nationkey, NULL FROM customer WHERE c_custkey % 3 = 0")
def initiative_artifacts(spark, sf_dir):
    d = _t(spark, sf_dir, "customer").selectExpr("c_custkey AS slug", "CASE WHEN c_custkey % 2 = 0 THEN array(named_struct('repo', 'r' || c_nationkey, 'name', 'b' || c_custkey, 'note', c_mktsegment)) END AS branches", "CASE WHEN c_custkey % 3 = 0 THEN array(named_struct('repo', 'r' || c_nationkey, 'path', '/w/' || c_nationkey, 'note', cast(null AS string))) END AS worktrees")
    return ledger.artifacts(d)


_STATE = "CASE c_custkey % 5 WHEN 0 THEN 'focused' WHEN 1 THEN 'backburner' WHEN 2 THEN 'paused' WHEN 3 THEN 'done' ELSE 'dropped' END"


@query("initiative_sections", f"""
WITH i AS (SELECT c_name AS slug, {_STATE} AS state, CASE WHEN c_nationkey > 5 THEN c_nationkey END AS rank, CASE WHEN c_nationkey % 3 > 0 THEN '2026-0' || c_nationkey % 9 END AS paused_since, CAST(c_nationkey AS VARCHAR) AS updated FROM customer WHERE c_custkey % 5 < 4)
SELECT upper(left(state, 1)) || substr(state, 2) AS heading, slug, CAST(row_number() OVER (PARTITION BY state ORDER BY CASE WHEN state = 'focused' THEN rank END NULLS LAST, CASE WHEN state = 'paused' THEN coalesce(paused_since, '') END, CASE WHEN state = 'done' THEN updated END DESC NULLS LAST, slug) AS INT) AS place FROM i""")
def initiative_sections(spark, sf_dir):
    i = _t(spark, sf_dir, "customer").selectExpr("c_name AS slug", f"{_STATE} AS state", "CASE WHEN c_nationkey > 5 THEN c_nationkey END AS rank", "CASE WHEN c_nationkey % 3 > 0 THEN '2026-0' || c_nationkey % 9 END AS paused_since", "cast(c_nationkey AS string) AS updated")
    return ledger.sections(i).select("heading", "slug", "place")


@query("brief_problems", f"""
SELECT c_custkey, concat_ws(',', CASE WHEN s = 'focused' AND c_nationkey <= 5 THEN 'focused without a rank' END, CASE WHEN s = 'paused' AND (c_nationkey % 3 = 0 OR c_nationkey % 2 = 0) THEN 'paused without date or trigger' END, CASE WHEN c_nationkey % 4 = 0 THEN 'no date' END) AS problems FROM (SELECT *, {_STATE} AS s FROM customer)""")
def brief_problems(spark, sf_dir):
    b = _t(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_STATE} AS state", "CASE WHEN c_nationkey > 5 THEN c_nationkey END AS rank", "CASE WHEN c_nationkey % 3 > 0 THEN '2026' END AS paused_since", "CASE WHEN c_nationkey % 2 > 0 THEN 't' END AS restart_trigger", "CASE WHEN c_nationkey % 4 > 0 THEN '2026-01-02' ELSE '2026-1-2' END AS updated")
    return ledger.brief_problems(b).select("c_custkey", F.array_join("problems", ",").alias("problems"))


@query("eligible_blobs", f"SELECT doc_id, anchored OR doc_id % 2 = 0 AS eligible FROM ({ORACLE_SQL['signature']})")
def eligible_blobs(spark, sf_dir):
    b = _blobs(spark, sf_dir).withColumn("is_error", F.col("doc_id") % 2 == 0)
    return templates.signatures(b).select("doc_id", "eligible")


@query("resume_snapshots", """
WITH s AS (SELECT o_custkey % 40 AS slug, 'f' || o_orderkey AS file, 's' || o_custkey AS session_id, o_orderdate AS ended, CASE WHEN o_orderstatus = 'F' THEN 'canonical' ELSE 'parallel' END AS track FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY track = 'canonical' DESC, ended DESC, ended DESC, file DESC) AS k FROM s), m AS (SELECT * FROM n WHERE k = 1),
t AS (SELECT c_custkey % 40 AS slug, c_custkey AS id, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_custkey % 40) AS n FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT m.slug, m.file, m.session_id, (SELECT count(*) FROM s WHERE s.slug = m.slug AND s.track <> 'canonical' AND s.ended > m.ended AND s.file <> m.file) AS parallel,
  (SELECT coalesce(string_agg(id, ',' ORDER BY r), '') FROM t WHERE t.slug = m.slug AND r <= 5) AS tasks, coalesce((SELECT max(n) FROM t WHERE t.slug = m.slug), 0) AS open_tasks, least(12, (SELECT count(*) FROM part WHERE p_partkey % 40 = m.slug)) AS notes FROM m""")
def resume_snapshots(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    sessions = o.selectExpr("o_custkey % 40 AS slug", "'f' || o_orderkey AS file", "'s' || o_custkey AS session_id", "cast(o_orderdate AS timestamp) AS started", "cast(o_orderdate AS timestamp) AS ended", "CASE WHEN o_orderstatus = 'F' THEN 'canonical' ELSE 'parallel' END AS track")
    tasks = _t(spark, sf_dir, "customer").selectExpr("c_custkey % 40 AS slug", "c_custkey AS id", "c_name AS title", "c_acctbal AS priority", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'done' ELSE 'open' END AS status", "date'2020-01-01' AS done_at")
    notes = _t(spark, sf_dir, "part").selectExpr("p_partkey % 40 AS slug", "p_partkey AS created", "p_name AS title")
    loops = sessions.selectExpr("slug", "ended", "file AS ref", "session_id AS text").limit(0)
    r = ledger.resume(sessions, loops, tasks, notes, F.lit("2002-01-01").cast("timestamp"))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    ids = F.array_join(F.transform(F.coalesce("tasks", F.array().cast(r.schema["tasks"].dataType)), lambda t: t["id"].cast("string")), ",")
    return r.select("slug", "file", "session_id", size("parallel").alias("parallel"), ids.alias("tasks"), F.coalesce(F.get("tasks", F.lit(0))["open_tasks"], F.lit(0)).alias("open_tasks"), size("notes").alias("notes"))

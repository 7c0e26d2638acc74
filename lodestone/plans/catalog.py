"""Queries over the stand-in evidence tables, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluation as ev
from lodestone.operators import graph as gr
from lodestone.operators import graph_store as gs
from lodestone.operators import ledger as lg
from lodestone.operators import ranking as rk
from lodestone.operators import sarif as sa
from lodestone.plans.registry import query
from lodestone.streaming import monitors as mo

AS_OF = "timestamp'2024-02-01 00:00:00'"


# --- selection and counting -------------------------------------------------------------------

query("src01_point_lookup", "SRC-01", "nodes", "SELECT node_id, node_type, label FROM nodes WHERE node_id = 'customer:7'")(lambda n: gs.point(n, "node_id", "customer:7").select("node_id", "node_type", "label"))
query("flt01_nodes_by_type", "FLT-01 SRC-02 SRC-03", "nodes", "SELECT node_id, label, snapshot_id FROM nodes WHERE repo_id = 'crm' AND node_type = 'class' AND snapshot_id = 'snap:1' ORDER BY node_id LIMIT 50")(lambda n: gs.by_type(n, "node_type", "class", "crm", "snap:1", 50, "node_id").select("node_id", "label", "snapshot_id"))
query("flt02_edges_by_type", "FLT-02", "edges", "SELECT edge_id, confidence FROM edges WHERE repo_id = 'sales' AND edge_type = 'calls' ORDER BY edge_id LIMIT 40")(lambda e: gs.by_type(e, "edge_type", "calls", "sales", None, 40, "edge_id").select("edge_id", "confidence"))
query("flt03_nodes_of_file", "FLT-03", "nodes", "WITH f AS (SELECT node_id, count(*) OVER () AS n, row_number() OVER (ORDER BY node_id) AS k FROM nodes WHERE repo_id = 'crm' AND file_path = 'src/crm/c3.py') SELECT node_id, n > 2 AS truncated FROM f WHERE k <= 2")(lambda n: gs.of_file(n, "crm", "src/crm/c3.py", 2).select("node_id", "truncated"))
query("flt04_nodes_in_span", "FLT-04", "nodes", "SELECT node_id, start_line, end_line FROM nodes WHERE repo_id = 'sales' AND file_path = 'tests/o5.py' AND start_line >= 50 AND end_line <= 300")(lambda n: gs.in_span(n, "sales", "tests/o5.py", 50, 300).select("node_id", "start_line", "end_line"))
query("flt05_snapshot_consistency", "FLT-05", "nodes", "SELECT repo_id, file_path, count(DISTINCT snapshot_id) AS snapshots, CASE WHEN count(DISTINCT snapshot_id) <= 1 THEN 'clean' ELSE 'mixed' END AS consistency FROM nodes GROUP BY repo_id, file_path")(lambda n: gs.consistency(n, "repo_id", "file_path"))
query("flt09_symbol_lookup", "FLT-09", "nodes", "SELECT node_id FROM nodes WHERE node_id = 'FRANCE' OR qualified_name = 'geo.EUROPE' OR label = 'geo.EUROPE'")(lambda n: gs.symbol(n, "geo.EUROPE").select("node_id"))
query("agg01_counts", "AGG-01", "nodes edges", "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges")(lambda n, e: n.agg(F.lit("nodes").alias("what"), F.count("*").alias("n")).unionByName(e.agg(F.lit("edges").alias("what"), F.count("*").alias("n"))))
query("agg02_node_type_counts", "AGG-02", "nodes", "SELECT repo_id, node_type, count(*) AS n FROM nodes GROUP BY repo_id, node_type")(lambda n: gs.type_counts(n, "node_type"))
query("agg02_edge_type_counts", "AGG-02", "edges", "SELECT repo_id, edge_type, count(*) AS n FROM edges GROUP BY repo_id, edge_type")(lambda e: gs.type_counts(e, "edge_type"))
query("flt16_endpoint_violations", "FLT-16", "edges nodes", """WITH k AS (SELECT node_id, CASE WHEN node_type = 'class' AND CAST(substr(node_id, 10) AS INT) % 3 = 0 THEN 'method' WHEN node_type = 'test' AND CAST(substr(node_id, 7) AS INT) % 2 = 0 THEN 'function' WHEN node_type = 'module' AND node_id = 'nation:7' THEN 'repo' ELSE node_type END AS t FROM nodes)
SELECT e.edge_id, s.t AS source_type, g.t AS target_type FROM edges e JOIN k s ON e.source_id = s.node_id JOIN k g ON e.target_id = g.node_id
WHERE (edge_type = 'contains' AND NOT (s.t IN ('repo','repository','package','directory','file','module','class','function','method','variable','type') AND g.t NOT IN ('repo','repository')))
OR (edge_type = 'imports' AND NOT (s.t IN ('file','module','package') AND g.t IN ('file','module','package')))
OR (edge_type = 'calls' AND NOT (s.t IN ('function','method') AND g.t IN ('function','method')))
OR (edge_type = 'tests' AND NOT (s.t IN ('test','generated_test') AND g.t IN ('class','function','method','variable','type','interface','idl_interface','http_route','websocket_event','grpc_service','protobuf_message')))""")(lambda e, n: gs.endpoint_violations(e, _typed(n)).select("edge_id", "source_type", "target_type"))


def _typed(n):
    number = F.element_at(F.split("node_id", ":"), 2).cast("int")
    kind = F.when((F.col("node_type") == "class") & (number % 3 == 0), "method").when((F.col("node_type") == "test") & (number % 2 == 0), "function").when((F.col("node_type") == "module") & (F.col("node_id") == "nation:7"), "repo").otherwise(F.col("node_type"))
    return n.withColumn("node_type", kind)


query("flt17_dangling_edges", "FLT-17", "edges nodes", "SELECT DISTINCT edge_id FROM edges WHERE target_id NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'interface') OR source_id NOT IN (SELECT node_id FROM nodes WHERE node_type <> 'interface')")(lambda e, n: gs.dangling(e, n.where("node_type <> 'interface'")).select("edge_id"))
query("d2_self_loops", "FLT-17", "edges", "SELECT edge_id FROM edges WHERE source_id = target_id")(lambda e: gs.self_loops(e).select("edge_id"))

# --- writing ------------------------------------------------------------------------------------

query("jon02_insert_edges", "JON-02", "edges nodes", "SELECT DISTINCT edge_id FROM edges WHERE source_id IN (SELECT node_id FROM nodes WHERE repo_id <> 'supply') AND target_id IN (SELECT node_id FROM nodes WHERE repo_id <> 'supply')")(lambda e, n: gs.insert_edges(e, n.where("repo_id <> 'supply'")).select("edge_id"))
query("jon03_insert_absent", "JON-03", "nodes", "SELECT node_id FROM nodes WHERE repo_id = 'crm' AND node_id NOT IN (SELECT node_id FROM nodes WHERE snapshot_id = 'snap:0')")(lambda n: gs.insert_absent(n.where("snapshot_id = 'snap:0'"), n.where("repo_id = 'crm'").select("node_id"), "node_id"))
query("src25_upsert", "SRC-25 SRC-28 EXT-17 EXT-20", "runs", "SELECT parent_id, max_by(run_id, struct_pack(a := start_ts, b := run_id)) AS run_id FROM runs GROUP BY parent_id")(lambda r: gs.upsert(r.where("status <> 'running'").withColumn("k", F.struct("start_ts", "run_id")), r.where("status = 'running'").withColumn("k", F.struct("start_ts", "run_id")), ["parent_id"], "k").select("parent_id", "run_id"))

FACTS = """SELECT concat(l_partkey) AS key, CASE WHEN l_linenumber % 3 = 0 THEN 'ctags' WHEN l_linenumber % 3 = 1 THEN 'ast' ELSE 'lsp' END AS backend, l_orderkey * 10 + l_linenumber AS backend_order, l_quantity AS strength, l_discount AS confidence, l_linenumber AS start_line, l_suppkey AS end_line FROM lineitem WHERE l_orderkey % 10 = 0"""


def _facts(li):
    return li.where("l_orderkey % 10 = 0").select(F.col("l_partkey").cast("string").alias("key"), F.when(F.col("l_linenumber") % 3 == 0, "ctags").when(F.col("l_linenumber") % 3 == 1, "ast").otherwise("lsp").alias("backend"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("backend_order"), F.col("l_quantity").alias("strength"), F.col("l_discount").alias("confidence"), F.col("l_linenumber").alias("start_line"), F.col("l_suppkey").alias("end_line"))


query("idx14_merge_facts", "IDX-14 SET-04", "lineitem", f"""WITH f AS ({FACTS}), r AS (SELECT *, row_number() OVER w AS k, first_value(start_line) OVER w AS s, first_value(end_line) OVER w AS e FROM f WINDOW w AS (PARTITION BY key ORDER BY strength DESC, confidence DESC, backend_order))
SELECT key, max(CASE WHEN k = 1 THEN backend END) AS backend, max(CASE WHEN k = 1 THEN confidence END) AS confidence, coalesce(string_agg(DISTINCT CASE WHEN k > 1 THEN backend END, ',' ORDER BY CASE WHEN k > 1 THEN backend END), '') AS merged, CAST(sum(CASE WHEN k > 1 AND (start_line <> s OR end_line <> e) THEN 1 ELSE 0 END) AS BIGINT) AS span_conflicts FROM r GROUP BY key""")(lambda li: gs.merge_facts(_facts(li)).select("key", "backend", "confidence", F.array_join("merged_backends", ",").alias("merged"), "span_conflicts"))
query("idx16_reconcile_nodes", "IDX-16 AGG-37", "lineitem", f"WITH f AS ({FACTS}) SELECT key, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends, CASE WHEN count(DISTINCT backend) > 1 THEN 'confirmed' ELSE 'single' END AS agreement FROM f GROUP BY key")(lambda li: gs.reconcile_nodes(_facts(li)).select("key", F.array_join("backends", ",").alias("backends"), "agreement"))
query("idx15_first_edges", "IDX-15", "edges", "SELECT edge_type, source_id, target_id, min(edge_id) AS edge_id FROM edges GROUP BY edge_type, source_id, target_id")(lambda e: gs.first_edges(e, "edge_id").select("edge_type", "source_id", "target_id", "edge_id"))
query("idx16_reconcile_edges", "IDX-16", "edges", """WITH g AS (SELECT *, min(target_id) OVER p AS lo, max(target_id) OVER p AS hi, min(confidence) OVER p AS least, row_number() OVER (PARTITION BY edge_type, source_id ORDER BY confidence DESC, edge_id) AS k FROM edges WINDOW p AS (PARTITION BY edge_type, source_id))
SELECT edge_id, CASE WHEN lo <> hi THEN 'conflicting' ELSE 'agreed' END AS status, CASE WHEN lo <> hi THEN least ELSE confidence END AS confidence FROM g WHERE lo <> hi OR k = 1""")(lambda e: gs.reconcile_edges(e).select("edge_id", "status", "confidence"))
WIN06 = """WITH RECURSIVE o AS (SELECT repo_id, coalesce(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '') AS module, node_id, CAST(floor((row_number() OVER (PARTITION BY repo_id, coalesce(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '') ORDER BY node_id) - 1) / 200) AS BIGINT) AS piece FROM nodes),
s AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY module, piece) AS i FROM (SELECT repo_id, module, piece, count(*) AS n FROM o GROUP BY ALL)),
p AS (SELECT repo_id, i, module, piece, CAST(0 AS BIGINT) AS chunk, n AS held FROM s WHERE i = 1 UNION ALL SELECT s.repo_id, s.i, s.module, s.piece, CASE WHEN held + n > 200 THEN chunk + 1 ELSE chunk END, CASE WHEN held + n > 200 THEN n ELSE held + n END FROM p JOIN s ON s.repo_id = p.repo_id AND s.i = p.i + 1)
SELECT o.repo_id, chunk, node_id FROM o JOIN p ON o.repo_id = p.repo_id AND o.module = p.module AND o.piece = p.piece"""
query("win06_module_chunks", "WIN-06 SRC-23", "nodes", WIN06)(lambda n: gs.chunk_by_module(n, 200))

# --- joins --------------------------------------------------------------------------------------

query("jon01_runs_of_incident", "JON-01 TOP-04", "runs links", "SELECT run_id, workflow FROM runs WHERE status = 'completed' AND run_id IN (SELECT run_id FROM links WHERE incident_id = 'inc:3')")(lambda r, k: r.where("status = 'completed'").join(k.where("incident_id = 'inc:3'"), "run_id", "left_semi").select("run_id", "workflow"))
query("jon04_incident_runs", "JON-04", "incidents links runs", "SELECT i.incident_id, i.severity, count(r.run_id) AS n_runs, round(coalesce(sum(r.cost), 0), 2) AS cost FROM incidents i LEFT JOIN links k ON i.incident_id = k.incident_id LEFT JOIN runs r ON k.run_id = r.run_id GROUP BY i.incident_id, i.severity")(lambda i, k, r: i.join(k.join(r, "run_id").groupBy("incident_id").agg(F.count("*").alias("n"), F.sum("cost").alias("c")), "incident_id", "left").select("incident_id", "severity", F.coalesce("n", F.lit(0)).alias("n_runs"), F.round(F.coalesce("c", F.lit(0.0)), 2).alias("cost")))
_BIND = """WITH a AS (SELECT DISTINCT rule_id, file_path, start_line, message, concat(rule_id, '|', file_path, '|', start_line, '|', message) AS alert_id FROM alerts_before), n AS (SELECT * FROM nodes WHERE repo_id = 'catalog' AND file_path IS NOT NULL),
h AS (SELECT a.alert_id, string_agg(DISTINCT n.node_id, ',' ORDER BY n.node_id) AS symbols FROM a JOIN n ON a.file_path = n.file_path AND a.start_line <= n.end_line AND a.start_line >= n.start_line GROUP BY a.alert_id),
f AS (SELECT file_path, min(node_id) AS file_node FROM n GROUP BY file_path)"""


def _bound(a, n):
    a = a.select("rule_id", "file_path", "start_line", "message").distinct().withColumn("alert_id", F.concat_ws("|", "rule_id", "file_path", F.col("start_line").cast("string"), "message"))
    return sa.bind(a, n, "catalog")


query("jon06_bind_alerts", "JON-05 JON-06 SAR-10", "alerts_before nodes", _BIND + " SELECT a.alert_id, f.file_node, coalesce(h.symbols, '') AS symbols, CASE WHEN h.symbols IS NOT NULL THEN 'symbol' WHEN f.file_node IS NOT NULL THEN 'file_only' ELSE 'unbound' END AS grade FROM a LEFT JOIN f ON a.file_path = f.file_path LEFT JOIN h ON a.alert_id = h.alert_id")(lambda a, n: _bound(a, n).select("alert_id", "file_node", F.array_join("symbols", ",").alias("symbols"), "grade"))
query("jon11_graph_facts", "JON-11 SAR-07", "alerts_before nodes", _BIND + ", u AS (SELECT alert_id, unnest(string_split(symbols, ',')) AS node_id, generate_subscripts(string_split(symbols, ','), 1) AS i FROM h) SELECT alert_id, node_id, CASE WHEN i = 1 THEN 'primary' ELSE 'secondary' END AS role FROM u UNION ALL SELECT a.alert_id, f.file_node, 'file_only' FROM a JOIN f ON a.file_path = f.file_path WHERE a.alert_id NOT IN (SELECT alert_id FROM h)")(lambda a, n: sa.graph_facts(_bound(a, n)))
_FP = "substr(sha256(concat_ws('|', analyser_id, rule_id, file_path, CASE WHEN start_line = 0 THEN '' ELSE CAST(start_line AS VARCHAR) END, trim(regexp_replace(message, '\\s+', ' ', 'g')), '')), 1, 16)"
query("sar06_fingerprints", "SAR-06", "alerts_before", f"SELECT rule_id, file_path, start_line, {_FP} AS fingerprint, count(*) AS n FROM alerts_before GROUP BY ALL")(lambda a: sa.identified(a).groupBy("rule_id", "file_path", "start_line", "fingerprint").agg(F.count("*").alias("n")))
query("jon07_sarif_delta", "JON-07 D12", "alerts_before alerts_after")(lambda b, a: sa.delta(b, a))
query("jon07_exact_delta", "JON-07 AGG-03", "alerts_before alerts_after", f"WITH b AS (SELECT DISTINCT concat('semgrep:', {_FP}) AS id FROM alerts_before), a AS (SELECT DISTINCT concat('semgrep:', {_FP}) AS id FROM alerts_after) SELECT CASE WHEN a.id IS NULL THEN 'disappeared' WHEN b.id IS NULL THEN 'appeared' ELSE 'unchanged' END AS change, coalesce(a.id, b.id) AS alert_id FROM b FULL JOIN a ON a.id = b.id")(lambda b, a: sa.exact_delta(b, a))
_RK = "concat_ws(':', rule_id, file_path, CAST(start_line AS VARCHAR), message)"
query("jon08_review_delta", "JON-08", "alerts_before alerts_after", f"WITH b AS (SELECT {_RK} AS key, max(severity) AS b FROM alerts_before GROUP BY 1), a AS (SELECT {_RK} AS key, max(severity) AS a FROM alerts_after GROUP BY 1), j AS (SELECT coalesce(a.key, b.key) AS key, a, b, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'fixed' WHEN a <> b THEN 'severity_changed' END AS change FROM b FULL JOIN a ON a.key = b.key) SELECT key, change, change = 'new' AND coalesce(a IN ('critical','error'), false) AS new_critical, change = 'new' AND regexp_matches(lower(key), 'cwe|injection|taint|xss') AS new_security FROM j WHERE change IS NOT NULL")(lambda b, a: sa.review_delta(b, a).withColumn("new_critical", F.coalesce("new_critical", F.lit(False))))
query("jon09_repair_delta", "JON-09", "alerts_before alerts_after", "WITH b AS (SELECT DISTINCT rule_id, file_path, start_line, 1 AS b FROM alerts_before), a AS (SELECT DISTINCT rule_id, file_path, start_line, 1 AS a FROM alerts_after) SELECT rule_id, count(*) FILTER (a IS NULL) AS gone, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS still, count(*) FILTER (b IS NULL) AS added FROM b FULL JOIN a USING (rule_id, file_path, start_line) GROUP BY rule_id")(lambda b, a: sa.repair_delta(b, a))
query("flt06_severe_alerts", "FLT-06", "alerts_before", "SELECT severity, count(*) AS n FROM alerts_before WHERE severity IN ('high','critical') GROUP BY severity")(lambda a: sa.at_least(a, "high").groupBy("severity").agg(F.count("*").alias("n")))
query("flt07_alerts_of_file", "FLT-07", "alerts_before", "SELECT rule_id, start_line, message FROM alerts_before WHERE file_path = 'src/catalog/p7.py'")(lambda a: a.where("file_path = 'src/catalog/p7.py'").select("rule_id", "start_line", "message"))
query("flt08_alerts_of_symbol", "FLT-08", "alerts_before nodes", _BIND + " SELECT alert_id FROM h WHERE list_contains(string_split(symbols, ','), 'part:7')")(lambda a, n: _bound(a, n).where(F.array_contains("symbols", "part:7")).select("alert_id"))
query("sar09_classify_alerts", "SAR-09 SAR-13 SAR-14", "alerts_before", "SELECT CASE WHEN suppressed THEN 'likely_false_positive' WHEN severity IN ('low','informational') THEN 'needs_review' ELSE 'likely_true_positive' END AS classification, severity, count(*) AS n FROM alerts_before GROUP BY 1, 2")(lambda a: sa.classify(a).groupBy("classification", "severity").agg(F.count("*").alias("n")))
query("jon12_state_diff", "JON-12 JON-13", "events", """WITH p AS (SELECT user_id, event_type AS fn, max_by(value, struct_pack(a := ts, b := event_id)) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), q AS (SELECT user_id, event_type AS fn, max_by(value, struct_pack(a := ts, b := event_id)) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL)
SELECT coalesce(p.user_id, q.user_id) AS user_id, coalesce(p.fn, q.fn) AS fn, p.v AS pre, q.v AS post, p.v IS DISTINCT FROM q.v AS diverged FROM p FULL JOIN q ON p.user_id = q.user_id AND p.fn = q.fn""")(lambda e: _state_diff(e))


def _state_diff(e):
    last = F.max_by("value", F.struct("ts", "event_id"))
    pre = e.where("ts < timestamp'2024-01-15'").groupBy("user_id", F.col("event_type").alias("fn")).agg(last.alias("pre"))
    post = e.where("ts >= timestamp'2024-01-15'").groupBy("user_id", F.col("event_type").alias("fn")).agg(last.alias("post"))
    return pre.join(post, ["user_id", "fn"], "full_outer").withColumn("diverged", ~F.col("pre").eqNullSafe(F.col("post")))


query("jon14_compare_snapshots", "JON-14 JON-15 JON-19", "part", """WITH b AS (SELECT concat(p_type, '#', p_size) AS name, min(p_brand) AS h FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1), c AS (SELECT concat(p_type, '#', p_size) AS name, min(p_brand) AS h FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1)
SELECT coalesce(b.name, c.name) AS name, CASE WHEN b.name IS NULL THEN 'compatible' WHEN c.name IS NULL THEN 'breaking' WHEN b.h <> c.h THEN 'policy_relevant' ELSE 'unchanged' END AS change FROM b FULL JOIN c ON b.name = c.name""")(lambda p: _snapshots(p))


def _snapshots(p):
    name = F.concat_ws("#", "p_type", F.col("p_size").cast("string")).alias("name")
    b = p.where("p_partkey % 3 <> 0").groupBy(name).agg(F.min("p_brand").alias("b"))
    c = p.where("p_partkey % 3 <> 1").groupBy(name).agg(F.min("p_brand").alias("c"))
    return b.join(c, "name", "full_outer").select("name", F.when(F.col("b").isNull(), "compatible").when(F.col("c").isNull(), "breaking").when(F.col("b") != F.col("c"), "policy_relevant").otherwise("unchanged").alias("change"))


query("jon18_recover", "JON-18 STR-05 STR-09", "events", """WITH l AS (SELECT event_type AS resource, ts FROM events), c AS (SELECT concat('u', user_id) AS client, event_type AS resource, CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(ts) - INTERVAL 3 DAY END AS last_ts FROM events WHERE user_id % 2 = 0 GROUP BY user_id, event_type),
g AS (SELECT client, c.resource, any_value(last_ts) AS last_ts, count(l.ts) AS logged, count(*) FILTER (l.ts > last_ts) AS missed, min(CASE WHEN l.ts > last_ts THEN l.ts END) AS oldest FROM c LEFT JOIN l ON c.resource = l.resource GROUP BY client, c.resource)
SELECT client, resource, CASE WHEN logged = 0 THEN 'none' WHEN last_ts IS NULL THEN 'resync' WHEN missed = 0 THEN 'none' WHEN epoch(TIMESTAMP '2024-02-01') - floor(epoch(oldest)) > 518400 THEN 'resync' ELSE 'replay' END AS action, CASE WHEN last_ts IS NOT NULL AND missed > 0 AND NOT epoch(TIMESTAMP '2024-02-01') - floor(epoch(oldest)) > 518400 THEN missed ELSE 0 END AS replayed FROM g""")(lambda e: lg.recover(e.where("user_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max("ts").alias("m")).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("client"), F.col("event_type").alias("resource"), F.when(F.col("user_id") % 5 != 0, F.col("m") - F.expr("INTERVAL 3 DAYS")).alias("last_ts")), e.select(F.col("event_type").alias("resource"), "ts"), F.expr(AS_OF), 518400))
query("jon20_append_absent", "JON-20 JON-21", "documents labels", "SELECT doc_id, CAST(1 AS DOUBLE) AS score FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, CAST(0.5 AS DOUBLE) FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")(lambda d, l: l.where("quality = 1").select("doc_id", F.lit(1.0).alias("score")).unionByName(d.where("lang = 'en'").join(l.where("quality = 1"), "doc_id", "left_anti").select("doc_id", F.lit(0.5).alias("score"))))

# --- run ledger ---------------------------------------------------------------------------------

query("agg21_repeated_calls", "AGG-21", "run_events", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id, type, stage ORDER BY seq) AS k FROM run_events) SELECT run_id, type, stage, count(*) AS n, string_agg(CASE WHEN k <= 5 THEN event_id END, ',' ORDER BY seq) AS evidence FROM r GROUP BY run_id, type, stage HAVING count(*) >= 5")(lambda e: lg.repeated_calls(e).withColumn("evidence", F.array_join("evidence", ",")))
_STORM = "i AS (SELECT *, sum(CASE WHEN policy_action = 'deny' THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY seq) AS g FROM run_events), k AS (SELECT *, (row_number() OVER (PARTITION BY run_id, g ORDER BY seq) - 1) // 3 AS b FROM i WHERE policy_action = 'deny')"
query("win01_denial_storms", "WIN-01", "run_events", f"WITH {_STORM} SELECT run_id, min(seq) AS first_seq, string_agg(event_id, ',' ORDER BY seq) AS evidence FROM k GROUP BY run_id, g, b HAVING count(*) = 3")(lambda e: lg.denial_storms(e).withColumn("evidence", F.array_join("evidence", ",")))
query("win02_failing_gates", "WIN-02", "run_events", "SELECT run_id, stage, count(*) AS n FROM run_events WHERE type = 'gate_failed' AND run_id NOT IN (SELECT run_id FROM run_events WHERE type LIKE '%code_change%' OR type LIKE '%diff_snapshot%') GROUP BY run_id, stage HAVING count(*) >= 3")(lambda e: lg.failing_gates(e))
query("agg22_context_growth", "AGG-22", "run_events", "SELECT run_id, count(*) FILTER (type = 'context_load') AS loads FROM run_events GROUP BY run_id HAVING count(*) FILTER (type = 'context_load') >= 5 AND count(*) FILTER (type IN ('tool_result','graph_query','sarif_result')) = 0")(lambda e: lg.context_growth(e))
query("agg23_anomalies", "AGG-23 AGG-21 WIN-01", "run_events", f"""WITH {_STORM}, f AS (
SELECT run_id, 'repeated_tool' AS kind, 'warning' AS severity FROM run_events GROUP BY run_id, type, stage HAVING count(*) >= 5
UNION ALL SELECT run_id, 'denial_storm', 'error' FROM k GROUP BY run_id, g, b HAVING count(*) = 3
UNION ALL SELECT run_id, CASE WHEN type = 'budget_hard_stop' THEN 'budget_exhaustion' WHEN type = 'stale_index_evidence' THEN 'stale_index' ELSE 'out_of_scope_write' END, CASE WHEN type = 'stale_index_evidence' THEN 'warning' ELSE 'error' END FROM run_events WHERE type IN ('budget_hard_stop','stale_index_evidence','out_of_scope_write')
UNION ALL SELECT run_id, 'context_growth', 'warning' FROM run_events GROUP BY run_id HAVING count(*) FILTER (type = 'context_load') >= 5 AND count(*) FILTER (type = 'tool_result') = 0
UNION ALL SELECT run_id, 'repeated_failing', 'warning' FROM run_events WHERE type = 'gate_failed' GROUP BY run_id, stage HAVING count(*) >= 3)
SELECT run_id, kind, severity, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT run_id, 'cumulative_risk', 'error', 1 FROM f WHERE severity = 'error' GROUP BY run_id HAVING count(*) >= 2 AND count(DISTINCT kind) >= 2""")(lambda e: lg.anomalies(e))
query("win03_tail_streak", "WIN-03", "run_events", "WITH g AS (SELECT *, sum(CASE WHEN type = 'gate_passed' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq DESC) AS ok FROM run_events WHERE type IN ('gate_failed','gate_passed')), t AS (SELECT *, first_value(stage) OVER (PARTITION BY run_id ORDER BY seq DESC) AS last FROM g WHERE ok = 0) SELECT run_id, stage AS gate, count(*) AS streak FROM t WHERE stage = last GROUP BY run_id, stage")(lambda e: lg.tail_streak(e))
query("win04_stage_sequence", "WIN-04", "run_events", "WITH s AS (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY seq) AS p FROM run_events WHERE stage <> '') SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS pos, stage FROM s WHERE p IS NULL OR p <> stage")(lambda e: lg.stages(e))
query("win05_next_sequence", "WIN-05 STR-04", "run_events", "SELECT run_id, count(*) + 1 AS next_seq FROM run_events GROUP BY run_id")(lambda e: lg.next_sequence(e))
query("flt18_sequence_violations", "FLT-18", "run_events", "WITH e AS (SELECT run_id, event_id, ts, CASE WHEN event_id LIKE '%7' THEN seq - 2 ELSE seq END AS seq FROM run_events), l AS (SELECT *, lag(seq) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS previous FROM e) SELECT run_id, event_id, seq, previous FROM l WHERE previous IS NOT NULL AND seq <= previous")(lambda e: lg.sequence_violations(e.withColumn("seq", F.when(F.col("event_id").endswith("7"), F.col("seq") - 2).otherwise(F.col("seq")))))
query("win07_byte_cap", "WIN-07 SRC-17", "documents", "WITH r AS (SELECT doc_id, lang, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY lang ORDER BY doc_id) AS r, sum(octet_length(encode(text)) + 1) OVER (PARTITION BY lang) AS w FROM documents) SELECT doc_id, lang, w > 100000 AS truncated FROM r WHERE r <= 100000")(lambda d: lg.byte_cap(d.select("doc_id", "lang", "text"), "lang", "doc_id", "text", 100000).select("doc_id", "lang", "truncated"))
query("win08_latest_run", "WIN-08 TOP-09 SRC-29", "runs", "SELECT parent_id, max_by(run_id, struct_pack(a := start_ts, b := run_id)) AS run_id, max(start_ts) AS start_ts FROM runs GROUP BY parent_id")(lambda r: rk.best_per(r, ["parent_id"], [F.desc("start_ts"), F.desc("run_id")]).select("parent_id", "run_id", "start_ts"))
query("agg24_compare_runs", "AGG-24", "run_events", """WITH a AS (SELECT * FROM run_events WHERE run_id = 'run:1'), b AS (SELECT * FROM run_events WHERE run_id = 'run:2'), x AS (SELECT CAST(sum(token_count) AS BIGINT) AS tokens_a, CAST(sum(wall_ms) AS BIGINT) AS wall_ms_a, count(*) FILTER (policy_action='deny') AS denied_a, count(*) FILTER (type IN ('tool_result','graph_query')) AS evidence_a, count(*) FILTER (type='gate_passed') AS passed_a, count(*) FILTER (type='gate_failed') AS failed_a FROM a), y AS (SELECT CAST(sum(token_count) AS BIGINT) AS tokens_b, CAST(sum(wall_ms) AS BIGINT) AS wall_ms_b, count(*) FILTER (policy_action='deny') AS denied_b, count(*) FILTER (type IN ('tool_result','graph_query')) AS evidence_b, count(*) FILTER (type='gate_passed') AS passed_b, count(*) FILTER (type='gate_failed') AS failed_b FROM b)
SELECT *, coalesce(tokens_b,0) - coalesce(tokens_a,0) AS tokens_delta, coalesce(wall_ms_b,0) - coalesce(wall_ms_a,0) AS wall_ms_delta, denied_b - denied_a AS denied_delta, evidence_b - evidence_a AS evidence_delta FROM x, y""")(lambda e: lg.compare_runs(e, F.lit("run:1"), F.lit("run:2")))
query("set01_sequence_diff", "SET-01 SET-02 SET-03 AGG-28", "run_events", "SELECT type AS value, CASE WHEN bool_or(run_id='run:1') AND bool_or(run_id='run:2') THEN 'common' WHEN bool_or(run_id='run:1') THEN 'only_a' ELSE 'only_b' END AS side FROM run_events WHERE run_id IN ('run:1','run:2') GROUP BY type")(lambda e: lg.sequence_diff(e, "type", "run:1", "run:2"))
query("flt15_retention", "FLT-15 AGG-27 SRC-21", "events", "WITH d AS (SELECT event_type, epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS age, CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 20 WHEN 'error' THEN -1 END AS days FROM events) SELECT event_type, count(*) FILTER (coalesce(days >= 0 AND age > days * 86400, false)) AS expired, count(*) AS n FROM d GROUP BY event_type")(lambda e: lg.retained(e, "event_type", "ts", F.expr(AS_OF), {"click": 5, "view": 20, "error": -1}).groupBy("event_type").agg(F.count_if("expired").alias("expired"), F.count("*").alias("n")))
query("str03_running_budget", "STR-03 FUN-19 STR-14 STR-08", "run_events", "WITH u AS (SELECT *, sum(token_count) OVER w AS t, sum(CASE WHEN type='tool_call' THEN 1 ELSE 0 END) OVER w AS c FROM run_events WINDOW w AS (PARTITION BY run_id ORDER BY seq)) SELECT run_id, CASE WHEN t >= 20000 OR c >= 15 THEN 'hard_stop' WHEN t / 20000.0 >= 0.8 OR c / 15.0 >= 0.8 THEN 'soft_warning' ELSE 'ok' END AS status, count(*) AS n FROM u GROUP BY 1, 2")(lambda e: lg.running_budget(e, 20000, 15).groupBy("run_id", "status").agg(F.count("*").alias("n")))
query("agg12_process_compliance", "AGG-12 AGG-40 FLT-13", "run_events", "WITH s AS (SELECT run_id, list(DISTINCT type) AS seen FROM run_events GROUP BY run_id) SELECT run_id, array_to_string(list_sort(list_filter(['context_load','gate_passed','tool_result','gate_failed'], lambda x: NOT list_contains(seen, x))), ',') AS missing, len(list_filter(['context_load','gate_passed','tool_result','gate_failed'], lambda x: NOT list_contains(seen, x))) = 0 AS compliant FROM s")(lambda e: lg.process_compliance(e, ["context_load", "gate_passed", "tool_result", "gate_failed"]).withColumn("missing", F.array_join("missing", ",")))

# --- graph --------------------------------------------------------------------------------------

query("grf01_neighbours", "GRF-01", "edges", "SELECT edge_id, edge_type, target_id AS neighbour, 'out' AS way FROM edges WHERE source_id = 'nation:3' UNION ALL SELECT edge_id, edge_type, source_id, 'in' FROM edges WHERE target_id = 'nation:3'")(lambda e: gr.neighbours(e, "nation:3"))
_U = "u AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges)"
query("grf02_ego_graph", "GRF-02 GRF-04 RNK-10", "edges", f"WITH {_U}, h1 AS (SELECT DISTINCT b FROM u WHERE a = 'supplier:2'), h2 AS (SELECT DISTINCT b FROM u WHERE a IN (SELECT b FROM h1)), x AS (SELECT 'supplier:2' AS node_id, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2) SELECT node_id, min(hop) AS hop FROM x GROUP BY node_id")(lambda e: gr.ego(e, e.sparkSession.createDataFrame([("supplier:2",)], "node_id string"), 2))
query("grf02_induced_edges", "GRF-02 SET-05", "edges nodes", "SELECT edge_id FROM edges WHERE source_id IN (SELECT node_id FROM nodes WHERE repo_id IN ('geo','supply')) AND target_id IN (SELECT node_id FROM nodes WHERE repo_id IN ('geo','supply'))")(lambda e, n: gr.induced(e, n.where(F.col("repo_id").isin("geo", "supply"))).select("edge_id"))
query("grf03_callers", "GRF-03", "edges", "WITH c AS (SELECT source_id AS a, target_id AS b FROM edges WHERE edge_type = 'calls'), s AS (SELECT DISTINCT a AS node_id FROM c WHERE b = 'customer:4'), h AS (SELECT b AS node_id FROM c WHERE a IN (SELECT node_id FROM s) UNION SELECT a FROM c WHERE b IN (SELECT node_id FROM s)) SELECT node_id, 0 AS hop FROM s UNION ALL SELECT node_id, 1 FROM h WHERE node_id NOT IN (SELECT node_id FROM s)")(lambda e: gr.callers(e, "customer:4"))
query("grf04_slice_one_hop", "GRF-04", "edges nodes", "WITH s AS (SELECT node_id FROM nodes WHERE file_path = 'src/geo/n1.py') SELECT node_id FROM s UNION SELECT target_id FROM edges WHERE edge_type IN ('contains','imports') AND source_id IN (SELECT node_id FROM s) UNION SELECT source_id FROM edges WHERE edge_type IN ('contains','imports') AND target_id IN (SELECT node_id FROM s)")(lambda e, n: gr.with_one_hop(n.where("file_path = 'src/geo/n1.py'"), e, ["contains", "imports"]))
_BR = """s AS (SELECT source_id AS a, target_id AS b FROM edges WHERE confidence >= 0.7 AND edge_type IN ('calls','imports','tests','exposes','consumes')), h0 AS (SELECT unnest(['order:1','order:2','order:33']) AS node_id), h1 AS (SELECT DISTINCT b AS node_id FROM s WHERE a IN (SELECT node_id FROM h0) AND b NOT IN (SELECT node_id FROM h0)), v1 AS (SELECT node_id FROM h0 UNION SELECT node_id FROM h1), h2 AS (SELECT DISTINCT b AS node_id FROM s WHERE a IN (SELECT node_id FROM h1) AND b NOT IN (SELECT node_id FROM v1)), v2 AS (SELECT node_id FROM v1 UNION SELECT node_id FROM h2), h3 AS (SELECT DISTINCT b AS node_id FROM s WHERE a IN (SELECT node_id FROM h2) AND b NOT IN (SELECT node_id FROM v2)), v3 AS (SELECT node_id FROM v2 UNION SELECT node_id FROM h3), h4 AS (SELECT DISTINCT b AS node_id FROM s WHERE a IN (SELECT node_id FROM h3) AND b NOT IN (SELECT node_id FROM v3)), v4 AS (SELECT node_id FROM v3 UNION SELECT node_id FROM h4), h5 AS (SELECT DISTINCT b AS node_id FROM s WHERE a IN (SELECT node_id FROM h4) AND b NOT IN (SELECT node_id FROM v4))"""
query("grf05_blast_radius", "GRF-05 GRF-08 GRF-10", "edges nodes", f"WITH {_BR} SELECT node_id, 1 AS hop FROM h1 UNION ALL SELECT node_id, 2 FROM h2 UNION ALL SELECT node_id, 3 FROM h3 UNION ALL SELECT node_id, 4 FROM h4 UNION ALL SELECT node_id, 5 FROM h5")(lambda e, n: gr.blast_radius(e, n, ["order:1", "order:2", "order:33"], "public_api_change")[0].select("node_id", "hop"))
query("grf06_impact_groups", "GRF-06 GRF-09 GRF-18", "edges nodes", "SELECT node_type, edge_type, CASE WHEN node_type = 'test' OR edge_type = 'tests' THEN 'tests' WHEN node_type = 'interface' OR edge_type IN ('exposes','consumes') THEN 'interfaces' ELSE 'direct_callers' END AS impact_group, count(*) AS n FROM edges e JOIN nodes n ON e.target_id = n.node_id GROUP BY ALL")(lambda e, n: e.join(n, F.col("target_id") == F.col("node_id")).groupBy("node_type", "edge_type", gr.impact_group(F.col("node_type"), F.col("edge_type"), F.lit(1)).alias("impact_group")).agg(F.count("*").alias("n")))
query("grf07_change_types", "GRF-07 GRF-17", "pages", """WITH p AS (SELECT page_id, concat('src/', CASE WHEN page_id % 5 = 0 THEN 'auth/' ELSE 'core/' END, CASE WHEN page_id % 3 = 0 THEN 'x_pb2.py' WHEN page_id % 3 = 1 THEN 'api.proto' ELSE 'main.py' END) AS f, page_id % 7 = 0 AS api FROM pages), k AS (SELECT page_id, (CASE WHEN f LIKE '%_pb2%' THEN 1 ELSE 0 END) AS g, (CASE WHEN f LIKE '%.proto' THEN 1 ELSE 0 END) AS i, (CASE WHEN api THEN 1 ELSE 0 END) AS a, (CASE WHEN f LIKE '%/auth/%' THEN 1 ELSE 0 END) AS s FROM p)
SELECT page_id, CASE WHEN g+i+a+s = 0 THEN 'internal_implementation' WHEN g+i+a+s > 1 THEN 'mixed' WHEN g = 1 THEN 'generated_file_change' WHEN i = 1 THEN 'idl_schema_contract_change' WHEN a = 1 THEN 'public_api_change' ELSE 'security_sensitive_change' END AS change FROM k""")(lambda p: p.select("page_id", gr.change_type(F.array(F.concat(F.lit("src/"), F.when(F.col("page_id") % 5 == 0, "auth/").otherwise("core/"), F.when(F.col("page_id") % 3 == 0, "x_pb2.py").when(F.col("page_id") % 3 == 1, "api.proto").otherwise("main.py"))), F.col("page_id") % 7 == 0, F.lit(False)).alias("change")))
query("grf11_cross_language", "GRF-11", "edges", "WITH c AS (SELECT * FROM edges WHERE confidence >= 0.8 AND edge_type IN ('exposes','consumes')), u AS (SELECT source_id AS a, target_id AS b FROM c UNION ALL SELECT target_id, source_id FROM c), h1 AS (SELECT DISTINCT b FROM u WHERE a = 'nation:1'), h2 AS (SELECT DISTINCT b FROM u WHERE a IN (SELECT b FROM h1)) SELECT node_id, min(hop) AS hop FROM (SELECT 'nation:1' AS node_id, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2) GROUP BY node_id")(lambda e: gr.cross_language(e, e.sparkSession.createDataFrame([("nation:1",)], "node_id string"), 2, 0.8))
query("grf12_shortest_path", "GRF-12", "edges", """WITH RECURSIVE l AS (SELECT edge_id, source_id AS a, target_id AS b FROM edges UNION ALL SELECT edge_id, target_id, source_id FROM edges),
t(node, nodes, ids, hop) USING KEY (node) AS (SELECT 'customer:1', ['customer:1'], CAST([] AS VARCHAR[]), 0 UNION SELECT b, x.n, x.e, hop FROM (SELECT b, min({'n': list_append(nodes, b), 'e': list_append(ids, edge_id)}) AS x, min(hop) + 1 AS hop FROM t JOIN l ON l.a = t.node WHERE b NOT IN (SELECT node FROM recurring.t) AND hop < 6 AND NOT EXISTS (SELECT 1 FROM recurring.t WHERE node = 'supplier:1') GROUP BY b))
SELECT len(nodes) - 1 AS hops, array_to_string(nodes, ',') AS nodes, array_to_string(ids, ',') AS edges FROM t WHERE node = 'supplier:1'""")(lambda e: gr.shortest_path(e, "customer:1", "supplier:1", 6).withColumn("nodes", F.array_join("nodes", ",")).withColumn("edges", F.array_join("edges", ",")))
#: Two hops from the files of c (repo_id, file_path, score), as ex (repo_id, file_path, hop, score).
EXPAND = """pl AS (SELECT node_id, repo_id, file_path FROM nodes WHERE file_path IS NOT NULL), lk AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges),
f0 AS (SELECT node_id, score AS base FROM pl JOIN c USING (repo_id, file_path)), n1 AS (SELECT b, p.repo_id, p.file_path, max(base) AS base FROM lk JOIN f0 ON lk.a = f0.node_id JOIN pl p ON p.node_id = lk.b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo_id = p.repo_id AND c.file_path = p.file_path) GROUP BY ALL),
e1 AS (SELECT repo_id, file_path, 1 AS hop, least(max(base) * 0.6::DOUBLE, 1.0) AS score FROM n1 GROUP BY ALL), n2 AS (SELECT lk.b, p.repo_id, p.file_path, max(base) AS base FROM lk JOIN n1 ON lk.a = n1.b JOIN pl p ON p.node_id = lk.b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo_id = p.repo_id AND c.file_path = p.file_path) AND NOT EXISTS (SELECT 1 FROM e1 WHERE e1.repo_id = p.repo_id AND e1.file_path = p.file_path) GROUP BY ALL),
e2 AS (SELECT repo_id, file_path, 2 AS hop, least(max(base) * pow(0.6::DOUBLE, 2), 1.0) AS score FROM n2 GROUP BY ALL), ex AS (SELECT * FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) ORDER BY hop, score DESC, repo_id, file_path LIMIT 20)"""
query("grf14_expand_files", "GRF-14", "nodes edges", f"WITH c AS (SELECT * FROM (VALUES ('geo', 'src/geo/n1.py', 0.9::DOUBLE), ('crm', 'src/crm/c3.py', 0.5::DOUBLE)) t(repo_id, file_path, score)), {EXPAND} SELECT repo_id, file_path, hop, round(score, 9) AS score FROM ex")(lambda n, e: gr.expand_files(n, e, e.sparkSession.createDataFrame([("geo", "src/geo/n1.py", 0.9), ("crm", "src/crm/c3.py", 0.5)], "repo_id string, file_path string, score double")).withColumn("score", F.round("score", 9)))

# --- ranking ------------------------------------------------------------------------------------

_ISSUE = "the thing is ending and thion the whating of there"
_TOK = "list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda t: regexp_replace(lower(t), 'ing$', ''))"
query("agg04_term_frequency", "AGG-04 RNK-04", "documents", f"WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents WHERE lang = 'en' AND doc_id % 3 = 0) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term")(lambda d: d.where("lang = 'en' and doc_id % 3 = 0").select("doc_id", F.explode(rk.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")))
query("rnk03_keyword_retrieval", "RNK-03", "documents", f"WITH q AS (SELECT DISTINCT unnest({_TOK.replace('text', chr(39) + _ISSUE + chr(39))}) AS term), t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), h AS (SELECT doc_id, t.term, count(*) AS tf FROM t JOIN q ON t.term = q.term WHERE q.term NOT IN ('the','and','or','to','in','a','of','when','is','it','on') GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term) SELECT doc_id AS id, round(sum(tf * ln(CAST((SELECT count(*) FROM documents) + 1 AS DOUBLE) / (df + 1) + 1)), 6) AS score FROM h JOIN f USING (term) GROUP BY doc_id")(lambda d: rk.keyword_scores(d.select(F.col("doc_id").alias("id"), "text"), _ISSUE).withColumn("score", F.round("score", 6)))


def keyword_sql(text: str, files: list[str], symbols: list[str]) -> str:
    """CTEs that end in kw (repo_id, file_path, node_id, score): the keyword candidates of nodes."""
    asked = " ".join([*files, *symbols, text]).replace("'", "''")
    bonus = f"CASE WHEN file_path IN ({', '.join(repr(f) for f in files)}) THEN 2.0 ELSE 0.0 END + CASE WHEN coalesce(nullif(qualified_name, ''), label) IN ({', '.join(repr(x) for x in symbols)}) THEN 1.5 ELSE 0.0 END"
    return f"""kq AS (SELECT DISTINCT unnest({_TOK.replace('text', chr(39) + asked + chr(39))}) AS term), kc AS (SELECT node_id, concat_ws(' ', coalesce(label, ''), coalesce(qualified_name, ''), coalesce(file_path, '')) AS text FROM nodes), kt AS (SELECT node_id, unnest({_TOK}) AS term FROM kc),
kh AS (SELECT node_id, kt.term, count(*) AS tf FROM kt JOIN kq ON kt.term = kq.term WHERE kq.term NOT IN ('the','and','or','to','in','a','of','when','is','it','on') GROUP BY ALL), kf AS (SELECT term, count(*) AS df FROM kh GROUP BY term),
ks AS (SELECT node_id, sum(tf * ln(CAST((SELECT count(*) FROM nodes) + 1 AS DOUBLE) / (df + 1) + 1)) AS s FROM kh JOIN kf USING (term) GROUP BY node_id),
kb AS (SELECT repo_id, file_path, n.node_id, CAST(coalesce(s, 0) + {bonus} AS DOUBLE) AS score FROM nodes n LEFT JOIN ks ON n.node_id = ks.node_id WHERE file_path <> ''), kr AS (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY round(score, 9) DESC, node_id) AS k FROM kb WHERE score > 0),
kw AS (SELECT repo_id, file_path, node_id, score / max(score) OVER () AS score FROM kr WHERE k = 1)"""


query("top02_keyword_candidates", "RNK-03 TOP-02", "nodes", f"WITH {keyword_sql(_ISSUE + ' geo', ['src/geo/n1.py'], ['geo.FRANCE'])} SELECT repo_id, file_path, node_id, round(score, 6) AS score FROM kw")(lambda n: rk.keyword_candidates(n, _ISSUE + " geo", ["src/geo/n1.py"], ["geo.FRANCE"]).withColumn("score", F.round("score", 6)))
query("agg07_merge_signals", "AGG-07 AGG-08 TOP-01", "signals", """WITH w AS (SELECT *, CASE signal_type WHEN 'keyword' THEN 0.25 WHEN 'sarif' THEN 0.2 WHEN 'blame' THEN 0.15 WHEN 'graph_neighbour' THEN 0.1 END::DOUBLE AS w FROM signals), t AS (SELECT repo_id, file_path, signal_type, sum(raw_score * w) AS s, any_value(w) AS w, bool_or(raw_score > 0.3) AS strong, bool_or(is_generated) AS g FROM w GROUP BY ALL), x AS (SELECT repo_id, file_path, bool_or(g) AS is_generated, count(*) AS types, least(sum(s) / sum(w), 1.0) AS score, count(*) FILTER (strong)::DOUBLE / count(*) AS agreement FROM t GROUP BY repo_id, file_path)
SELECT repo_id, file_path, is_generated, types, round(score, 6) AS score, round(agreement, 6) AS agreement, CASE WHEN agreement >= 0.6 THEN 'analyser' ELSE 'heuristic' END AS confidence FROM x WHERE score >= 0.05""")(lambda s: rk.merge_signals(s).withColumn("score", F.round("score", 6)).withColumn("agreement", F.round("agreement", 6)))
query("agg06_sarif_prior", "AGG-06 RNK-05", "alerts_before", "WITH m AS (SELECT file_path, CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 ELSE 0.2 END::DOUBLE * CASE WHEN lower(message) LIKE '%issue  3%' THEN 1.0 WHEN lower(rule_id) LIKE '%rule.ao%' THEN 0.9 WHEN severity IN ('critical','high') THEN 0.3 ELSE 0.0 END::DOUBLE AS s FROM alerts_before WHERE NOT suppressed), g AS (SELECT file_path, sum(s) AS s FROM m WHERE s > 0 GROUP BY file_path) SELECT file_path, round(s / (SELECT max(s) FROM g), 6) AS score FROM g")(lambda a: rk.sarif_prior(a, ["rule.AO"], ["Issue  3"], False, True).withColumn("score", F.round("score", 6)))
query("rnk06_blame_prior", "RNK-06 RNK-07 AGG-05", "orders", """WITH e AS (SELECT concat('f', o_custkey % 300) AS file_path, o_orderdate AS ts, o_orderpriority AS summary FROM orders WHERE o_orderkey % 4 = 0), c AS (SELECT file_path, count(*) AS churn FROM e GROUP BY file_path), x AS (SELECT e.file_path, lower(summary) LIKE '%urgent%' AS hit, churn, greatest((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 3600.0, 0) AS h FROM e JOIN c USING (file_path))
SELECT file_path, round(least(max(0.4 * exp(-CAST(h AS DOUBLE) / 168) + CASE WHEN hit THEN 0.4 ELSE 0 END + 0.2 * CAST(churn AS DOUBLE) / (SELECT max(churn) FROM c)), 1), 6) AS score FROM x WHERE hit OR churn > 1 GROUP BY file_path""")(lambda o: rk.blame_prior(o.where("o_orderkey % 4 = 0").select(F.concat(F.lit("f"), (F.col("o_custkey") % 300).cast("string")).alias("file_path"), F.col("o_orderdate").alias("author_ts"), F.col("o_orderpriority").alias("summary")), ["URGENT"], F.expr(AS_OF)).withColumn("score", F.round("score", 6)))
query("rnk08_ochiai", "RNK-08", "lineitem", "WITH c AS (SELECT l_partkey, CAST(count(*) FILTER (l_returnflag='R') AS DOUBLE) AS ef, CAST(count(*) FILTER (l_returnflag='A') AS DOUBLE) AS ep, CAST(count(*) FILTER (l_linestatus='F') AS DOUBLE) AS nf FROM lineitem GROUP BY l_partkey) SELECT l_partkey, round(CASE WHEN (ef+nf)*(ef+ep) > 0 THEN ef / sqrt((ef+nf)*(ef+ep)) ELSE 0 END, 6) AS score FROM c")(lambda li: li.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("ef"), F.count_if(F.col("l_returnflag") == "A").cast("double").alias("ep"), F.count_if(F.col("l_linestatus") == "F").cast("double").alias("nf")).select("l_partkey", F.round(rk.ochiai(F.col("ef"), F.col("ep"), F.col("nf"), F.lit(0.0)), 6).alias("score")))
query("top03_vector_top_k", "TOP-03 EXT-05", "embeddings", "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id < 5), d AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM d) SELECT query_id, id, round(s, 5) AS similarity FROM r WHERE k <= 8")(lambda e: rk.top_k(e.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 8).select("query_id", "id", F.round("similarity", 5).alias("similarity")))
query("top05_incidents", "TOP-05", "runs", "SELECT run_id, start_ts FROM runs ORDER BY start_ts DESC, run_id DESC LIMIT 25")(lambda r: r.select("run_id", "start_ts").orderBy(F.desc("start_ts"), F.desc("run_id")).limit(25))
query("top10_patch_selection", "TOP-10", "lineitem", "WITH c AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) OVER () * 0 + l_quantity AS files FROM lineitem) SELECT l_orderkey, min_by(l_linenumber, struct_pack(a := l_quantity, b := l_linenumber)) AS chosen FROM lineitem GROUP BY l_orderkey")(lambda li: li.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("chosen")))
query("top13_first_events", "TOP-13 TOP-15", "run_events", "SELECT run_id, seq, event_id FROM run_events WHERE seq <= 50")(lambda e: rk.first_per(e, ["run_id"], [F.col("seq")], 50).select("run_id", "seq", "event_id"))
query("rnk14_tiered_lookup", "RNK-14 RNK-15", "nodes", "WITH t AS (SELECT repo_id, node_id, CASE WHEN file_path LIKE '%/c3.py' THEN 1 WHEN contains(file_path, 'p5') THEN 2 WHEN contains(lower(label), 'o') THEN 3 END AS tier FROM nodes), m AS (SELECT *, min(tier) OVER (PARTITION BY repo_id) AS m FROM t WHERE tier IS NOT NULL) SELECT repo_id, node_id, tier FROM m WHERE tier = m")(lambda n: rk.tiered(n, [F.col("file_path").endswith("/c3.py"), F.col("file_path").contains("p5"), F.lower("label").contains("o")], ["repo_id"]).select("repo_id", "node_id", "tier"))
query("rnk19_memory_hints", "RNK-19 RNK-20 TOP-11 TOP-12", "documents labels", """WITH k AS (SELECT ['the','and','of','thion','thand'] AS kw), m AS (SELECT d.doc_id, list_distinct(list_filter(string_split_regex(lower(left(text, 200)), '\\s+'), lambda x: x <> '')) AS own, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS utility, d.doc_id % 11 = 0 AS expired, CASE WHEN d.doc_id % 5 = 0 THEN 'unreviewed' WHEN d.doc_id % 7 = 0 THEN 'superseded' ELSE 'reviewed' END AS rs FROM documents d JOIN labels l ON d.doc_id = l.doc_id), s AS (SELECT *, CASE WHEN len(own) > 0 THEN CAST(len(list_intersect(own, kw)) AS DOUBLE) / len(own) ELSE 0 END AS sim FROM m, k)
SELECT doc_id, round(sim, 6) AS similarity, CASE WHEN expired THEN 'expired' WHEN rs <> 'reviewed' THEN rs WHEN sim >= 0.85 AND utility = 'low' THEN 'high_similarity_low_utility' END AS reason FROM s""")(lambda d, l: _memory(d, l).select("doc_id", F.round("similarity", 6).alias("similarity"), rk.misaligned(F.col("expired"), F.col("rs"), F.col("similarity"), F.col("utility")).alias("reason")))


def _memory(d, l):
    own = F.filter(F.split(F.lower(F.substring("text", 1, 200)), r"\s+"), lambda x: x != "")
    m = d.join(l, "doc_id").select("doc_id", "lang", "quality", F.when(F.col("quality") == 1, "high").otherwise("low").alias("utility"), (F.col("doc_id") % 11 == 0).alias("expired"), F.when(F.col("doc_id") % 5 == 0, "unreviewed").when(F.col("doc_id") % 7 == 0, "superseded").otherwise("reviewed").alias("rs"), own.alias("own"))
    return m.withColumn("similarity", rk.word_overlap(F.array(*map(F.lit, ["the", "and", "of", "thion", "thand"])), F.col("own")))


query("agg26_memory_compaction", "AGG-26 RNK-21 RNK-22", "documents labels", "WITH m AS (SELECT lang, greatest(0, least(1, CASE WHEN quality = 1 THEN 1.0 ELSE 0.1 END + CASE WHEN d.doc_id % 2 = 0 THEN 0.2 ELSE 0 END - CASE WHEN d.doc_id % 3 = 0 THEN 0.2 ELSE 0 END)) AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT lang, count(*) AS n, round(sum(CAST(s AS DOUBLE)), 4) AS utility FROM m GROUP BY lang")(lambda d, l: d.join(l, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.sum(rk.utility_score(F.when(F.col("quality") == 1, "high").otherwise("low"), F.when(F.col("doc_id") % 2 == 0, "resolved").otherwise("open"), F.col("doc_id") % 3 == 0)), 4).alias("utility")))

# --- evaluation ---------------------------------------------------------------------------------

_ECE = "b AS (SELECT family, least(9, floor(predicted_probability * 10)) AS b, count(*) AS n, avg(CASE WHEN predicted_label = gold_label THEN 1.0 ELSE 0 END) AS acc, avg(predicted_probability) AS conf FROM samples GROUP BY 1, 2), e AS (SELECT family, sum(n * abs(acc - conf)) / sum(n) AS ece FROM b GROUP BY family)"
_F1 = "u AS (SELECT family, predicted_label AS p, gold_label AS g, unnest(list_distinct([predicted_label, gold_label])) AS label FROM samples), c AS (SELECT family, label, count(*) FILTER (p = label AND g = label) AS tp, count(*) FILTER (p = label AND g <> label) AS fp, count(*) FILTER (p <> label AND g = label) AS fn FROM u GROUP BY family, label), f AS (SELECT family, avg(2.0 * tp / (2 * tp + fp + fn)) AS macro_f1 FROM c GROUP BY family)"
query("agg13_ece", "AGG-13", "samples", f"WITH {_ECE} SELECT family, round(ece, 6) AS ece FROM e")(lambda s: ev.ece(s, "family").withColumn("ece", F.round("ece", 6)))
query("agg14_macro_f1", "AGG-14", "samples", f"WITH {_F1} SELECT family, round(macro_f1, 6) AS macro_f1 FROM f")(lambda s: ev.macro_f1(s, "family").withColumn("macro_f1", F.round("macro_f1", 6)))
query("agg15_calibration_report", "AGG-15 AGG-33", "samples", f"WITH {_ECE}, {_F1} SELECT round(max(ece), 6) AS ece, round(min(macro_f1), 6) AS macro_f1, bool_and(ece <= 0.1 AND macro_f1 >= 0.75) AS passed, string_agg(family, '+' ORDER BY family) AS families FROM e JOIN f USING (family)")(lambda s: ev.calibration_report(s).withColumn("ece", F.round("ece", 6)).withColumn("macro_f1", F.round("macro_f1", 6)))
query("agg11_flakiness", "AGG-11 AGG-38", "lineitem", "WITH c AS (SELECT l_partkey AS instance_id, count(*) FILTER (l_returnflag = 'N') AS passed, count(*) FILTER (l_returnflag <> 'N') AS failed FROM lineitem GROUP BY 1), p AS (SELECT *, CAST(passed AS DOUBLE) / (passed + failed) AS x FROM c), e AS (SELECT *, CASE WHEN passed = 0 OR failed = 0 THEN 0 ELSE -x * log2(x) - (1 - x) * log2(1 - x) END AS h FROM p) SELECT instance_id, passed, failed, round(h, 6) AS entropy, h > 0.3 AS flaky FROM e")(lambda li: ev.flakiness(li.select(F.col("l_partkey").alias("instance_id"), (F.col("l_returnflag") == "N").alias("ok"))).withColumn("entropy", F.round("entropy", 6)))


def _instances(li):
    g = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 20).alias("f")))), lambda x: x["f"]).alias("ranked"), F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 40, F.col("l_partkey") % 20))).alias("gold"), F.max("l_linestatus").alias("s"))
    a, b, c = ev.gold_coverage(F.col("ranked"), F.col("gold"), 5)
    return g.select("l_orderkey", F.size(F.array_distinct("gold")).alias("gold_count"), a.alias("top1"), b.alias("top3"), c.alias("topn"), (F.col("s") == "F").alias("repaired"), (F.col("l_orderkey") % 6 == 0).alias("flaky"))


_INST = "g AS (SELECT l_orderkey, list(l_partkey % 20 ORDER BY l_linenumber, l_partkey % 20) AS ranked, list_distinct(list(l_partkey % 20) FILTER (l_quantity > 40)) AS gold, max(l_linestatus) AS s FROM lineitem GROUP BY l_orderkey), i AS (SELECT l_orderkey, coalesce(len(gold), 0) AS gold_count, coalesce(len(gold), 0) > 0 AND list_has_all(ranked[1:greatest(1, len(gold))], gold) AS top1, coalesce(len(gold), 0) > 0 AND list_has_all(ranked[1:greatest(3, 3 * len(gold))], gold) AS top3, coalesce(len(gold), 0) > 0 AND list_has_all(ranked[1:greatest(5, len(gold))], gold) AS topn, s = 'F' AS repaired, l_orderkey % 6 = 0 AS flaky FROM g)"
query("agg10_gold_coverage", "AGG-10", "lineitem", f"WITH {_INST} SELECT l_orderkey, CAST(gold_count AS INT) AS gold_count, coalesce(top1, false) AS top1, coalesce(top3, false) AS top3, coalesce(topn, false) AS topn FROM i")(lambda li: _instances(li).select("l_orderkey", "gold_count", "top1", "top3", "topn"))
query("agg09_localisation_rates", "AGG-09", "lineitem", f"WITH {_INST}, k AS (SELECT * FROM i WHERE NOT flaky) SELECT count(*) AS instances, count(*) FILTER (gold_count <= 1) AS single_file, count(*) FILTER (gold_count > 1) AS multi_file, round(avg(CAST(coalesce(top1, false) AS INT)), 6) AS top1_rate, round(avg(CAST(coalesce(top3, false) AS INT)), 6) AS top3_rate, round(avg(CAST(coalesce(topn, false) AS INT)), 6) AS topn_rate, round(avg(CAST(repaired AS INT)) FILTER (top1 OR top3), 6) AS conditioned_repair_rate FROM k")(lambda li: ev.localisation_rates(_instances(li)).select("instances", "single_file", "multi_file", *(F.round(c, 6).alias(c) for c in ("top1_rate", "top3_rate", "topn_rate", "conditioned_repair_rate"))))
query("agg16_operational_gate", "AGG-16 AGG-41", "run_events", "WITH r AS (SELECT run_id, NOT bool_or(policy_action = 'deny') AS policy, sum(token_count) < 15000 AS budget, count(DISTINCT type) >= 5 AS trace FROM run_events GROUP BY run_id), m AS (SELECT avg(CAST(trace AS INT)) AS trace, avg(CAST(policy AS INT)) AS policy, avg(CAST(budget AS INT)) AS budget FROM r) SELECT round(trace, 6) AS trace, round(policy, 6) AS policy, round(budget, 6) AS budget, concat_ws(',', CASE WHEN trace < 0.9 THEN 'trace' END, CASE WHEN policy < 0.95 THEN 'policy' END, CASE WHEN budget < 0.9 THEN 'budget' END) AS failing, trace >= 0.9 AND policy >= 0.95 AND budget >= 0.9 AS passed FROM m")(lambda e: ev.operational_rates(e.groupBy("run_id").agg((~F.bool_or(F.col("policy_action") == "deny")).alias("policy"), (F.sum("token_count") < 15000).alias("budget"), (F.count_distinct("type") >= 5).alias("trace")), {"trace": 0.9, "policy": 0.95, "budget": 0.9}).select(*(F.round(c, 6).alias(c) for c in ("trace", "policy", "budget")), "failing", "passed"))
query("agg35_closure", "AGG-35", "incidents", "SELECT round(coalesce(avg(CASE WHEN state = 'closed' THEN 1.0 ELSE 0 END), 1), 6) AS closure_rate, count(*) AS incidents FROM incidents WHERE severity IN ('P0','P1')")(lambda i: ev.closure(i).withColumn("closure_rate", F.round("closure_rate", 6)))
query("agg17_resolve_by_language", "AGG-17 AGG-18", "documents labels", "WITH i AS (SELECT unnest(list_distinct([lang, CASE WHEN d.doc_id % 2 = 0 THEN 'en' ELSE 'de' END])) AS language, quality = 1 AS resolved FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT language, count(*) AS n, round(avg(CAST(resolved AS INT)), 6) AS resolve_rate FROM i GROUP BY language")(lambda d, l: ev.by_language(d.join(l, "doc_id").select(F.array_distinct(F.array("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de"))).alias("languages"), (F.col("quality") == 1).alias("resolved"))).withColumn("resolve_rate", F.round("resolve_rate", 6)))
query("agg19_verdict_matrix", "AGG-19 JON-17 AGG-39", "documents labels", "WITH j AS (SELECT d.source, CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN quality = 1 THEN 'satisfied' ELSE 'violated' END AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT source, count(*) FILTER (v='satisfied') AS satisfied, count(*) FILTER (v='violated') AS violated, count(*) FILTER (v='unknown') AS unknown, CASE WHEN count(*) FILTER (v='violated') > 0 THEN 'non_compliant' WHEN count(*) FILTER (v='unknown') > 0 THEN 'incomplete' WHEN count(*) FILTER (v='satisfied') > 0 THEN 'compliant' ELSE 'unknown' END AS status FROM j GROUP BY source")(lambda d, l: ev.verdict_matrix(d.select(F.col("doc_id").alias("clause_id"), "source"), l.select(F.col("doc_id").alias("clause_id"), F.when(F.col("quality") == 1, "satisfied").otherwise("violated").alias("verdict")), "source"))
query("agg20_aggregate_verdicts", "AGG-20 FUN-16 FUN-18 FLT-21 FLT-22", "documents labels", """WITH c AS (SELECT d.doc_id, CASE WHEN quality = 0 THEN 'violated' WHEN d.doc_id % 3 = 0 THEN 'satisfied' ELSE 'unknown' END AS s, CASE WHEN d.doc_id % 2 = 0 THEN 'parser' ELSE 'heuristic' END AS conf, CASE WHEN toxic = 1 THEN 'violated' ELSE 'unknown' END AS dy, CASE WHEN d.doc_id % 5 = 0 THEN 'security' ELSE 'correctness' END AS risk, d.doc_id % 7 = 0 AS orc FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE WHEN s='violated' OR dy='violated' THEN 'violated' WHEN s='satisfied' OR (orc AND risk <> 'security') THEN 'satisfied' ELSE 'unknown' END AS verdict, CASE WHEN s='violated' THEN 'static' WHEN dy='violated' THEN 'dynamic_trace' WHEN s='satisfied' THEN 'static' WHEN orc AND risk <> 'security' THEN 'calibrated_oracle' ELSE 'no_hard_evidence' END AS evidence, CASE WHEN s='violated' OR dy='violated' THEN false WHEN s='satisfied' AND conf='parser' THEN risk <> 'security' WHEN s='satisfied' THEN false ELSE orc AND risk <> 'security' END AS auto_pass FROM c""")(lambda d, l: d.join(l, "doc_id").select("doc_id", ev.aggregate_verdict(F.when(F.col("quality") == 0, "violated").when(F.col("doc_id") % 3 == 0, "satisfied").otherwise("unknown"), F.when(F.col("doc_id") % 2 == 0, "parser").otherwise("heuristic"), F.when(F.col("toxic") == 1, "violated").otherwise("unknown"), F.when(F.col("doc_id") % 5 == 0, "security").otherwise("correctness"), F.lit(True), F.col("doc_id") % 7 == 0).alias("v")).select("doc_id", "v.verdict", "v.evidence", "v.auto_pass"))
query("agg32_mixed_snapshots", "AGG-32", "nodes", "WITH g AS (SELECT repo_id, count(DISTINCT snapshot_id) AS snapshots, count(*) FILTER (start_line % 2 = 0) AS dirty, count(*) AS n FROM nodes GROUP BY repo_id) SELECT repo_id, snapshots, dirty, CASE WHEN snapshots > 1 OR (dirty > 0 AND dirty < n) THEN 'mixed' WHEN dirty > 0 THEN 'dirty' ELSE 'clean' END AS status FROM g")(lambda n: ev.mixed_snapshots(n.select("repo_id", "snapshot_id", (F.col("start_line") % 2 == 0).alias("dirty")), "repo_id").select("repo_id", "snapshots", "dirty", "status"))
query("agg34_ablation", "AGG-34 JON-16", "orders", """WITH f AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 300000 AS value FROM orders GROUP BY 1), a AS (SELECT concat('no', o_orderstatus) AS ablation, o_orderpriority AS metric, avg(o_totalprice) / 300000 AS value FROM orders GROUP BY 1, 2), d AS (SELECT ablation, f.value - a.value AS d FROM f JOIN a USING (metric))
SELECT ablation, CASE WHEN max(d) >= 0.1 THEN 'critical' WHEN max(d) >= 0.03 THEN 'moderate' WHEN max(d) > 0 THEN 'minor' ELSE 'none' END AS impact FROM d GROUP BY ablation""")(lambda o: ev.roll_up(ev.ablation(o.groupBy(F.col("o_orderpriority").alias("metric")).agg((F.avg("o_totalprice") / 300000).alias("value")), o.groupBy(F.concat(F.lit("no"), "o_orderstatus").alias("ablation"), F.col("o_orderpriority").alias("metric")).agg((F.avg("o_totalprice") / 300000).alias("value")))))
query("agg33_gate_roll_up", "AGG-33 EXT-12", "supplier", "SELECT s_nationkey, bool_and(s_acctbal > 0) AS passed, coalesce(string_agg(DISTINCT CASE WHEN NOT s_acctbal > 0 THEN s_name END, ',' ORDER BY CASE WHEN NOT s_acctbal > 0 THEN s_name END), '') AS failing FROM supplier GROUP BY s_nationkey")(lambda s: ev.gate_roll_up(s.select("s_nationkey", F.col("s_name").alias("gate"), (F.col("s_acctbal") > 0).alias("passed")), "s_nationkey"))
query("agg30_readiness", "AGG-30 AGG-31 AGG-42", "customer", "SELECT c_nationkey, CAST(greatest(0, least(20, count(*))) + greatest(0, least(20, count(*) FILTER (c_acctbal > 0) * 3)) + greatest(0, least(20, count(DISTINCT c_mktsegment) * 5)) AS BIGINT) AS score FROM customer GROUP BY c_nationkey")(lambda c: c.groupBy("c_nationkey").agg(F.count("*").alias("a"), F.count_if(F.col("c_acctbal") > 0).alias("b"), F.count_distinct("c_mktsegment").alias("d")).select("c_nationkey", ev.readiness([F.col("a"), F.col("b") * 3, F.col("d") * 5]).alias("score")))

# --- text ---------------------------------------------------------------------------------------

query("fun01_redaction", "FUN-01 FUN-03 EXT-14", "documents", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(?:passw(?:or)?d|secret|token|(?:api|private|access)[_\-]?key)\s*[=:]\s*[''"]?[A-Za-z0-9_+/=\-]{8,}[''"]?', '[REDACTED]', 'g'), '(?i)bearer\s+[A-Za-z0-9_\-.~+/]+=*', '[REDACTED]', 'g'), 'ghp_[A-Za-z0-9]{36}', '[REDACTED]', 'g'), 'sk-[A-Za-z0-9]{32,}', '[REDACTED]', 'g'), '\b[A-Za-z0-9_.%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[REDACTED]', 'g')) AS digest FROM documents WHERE lang = 'en'""")(lambda d: d.where("lang = 'en'").select("doc_id", F.md5(tx.redact(F.col("text"))).alias("digest")))
query("fun02_secret_documents", "FUN-02", "documents", r"""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:passw(?:or)?d|secret|token|(?:api|private|access)[_\-]?key)\s*[=:]\s*[''"]?[A-Za-z0-9_+/=\-]{8,}') OR regexp_matches(text, '(?i)bearer\s+[A-Za-z0-9_\-.~+/]+=*') OR regexp_matches(text, 'ghp_[A-Za-z0-9]{36}') OR regexp_matches(text, 'sk-[A-Za-z0-9]{32,}')""")(lambda d: d.where(tx.has_secret(F.col("text"))).select("doc_id"))
query("idx28_url_paths", "IDX-28", "pages", r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN concat('/users//<int:id>/:name/', page_id, '/?q=1') WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN url ELSE url END AS u FROM pages), a AS (SELECT page_id, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) ELSE regexp_extract(u, '^([^?]*)', 1) END AS x FROM p), b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '<(?:[^:<>]+:)?([^<>]+)>', '{\1}', 'g'), ':([A-Za-z_][A-Za-z0-9_]*)', '{\1}', 'g'), '//+', '/', 'g') AS x FROM a), c AS (SELECT page_id, CASE WHEN x LIKE '/%' THEN x ELSE concat('/', x) END AS x FROM b), d AS (SELECT page_id, CASE WHEN length(x) > 1 THEN rtrim(x, '/') ELSE x END AS x FROM c) SELECT page_id, CASE WHEN x = '' THEN '/' ELSE x END AS path FROM d""")(lambda p: p.select("page_id", tx.url_path(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/users//<int:id>/:name/"), F.col("page_id").cast("string"), F.lit("/?q=1"))).otherwise(F.col("url"))).alias("path")))
query("idx29_route_match", "IDX-29 JON-10", "nation", """WITH l AS (SELECT n_nationkey AS l, concat('/api/', n_regionkey, '/{id}') AS a FROM nation), r AS (SELECT n_nationkey AS r, CASE WHEN n_nationkey % 2 = 0 THEN concat('/api/', n_regionkey, '/{key}') ELSE concat('/api/', n_regionkey) END AS b FROM nation WHERE n_nationkey < 6), x AS (SELECT l, r, a, b, regexp_replace(a, '[{][^}]+[}]', '{}', 'g') AS p, regexp_replace(b, '[{][^}]+[}]', '{}', 'g') AS q FROM l, r) SELECT l, r, CASE WHEN a = b THEN 'parser' WHEN p = q THEN 'analyser' ELSE 'heuristic' END AS grade FROM x WHERE a = b OR p = q OR starts_with(p, q) OR starts_with(q, p)""")(lambda n: n.select(F.col("n_nationkey").alias("l"), F.concat_ws("", F.lit("/api/"), F.col("n_regionkey").cast("string"), F.lit("/{id}")).alias("a")).crossJoin(n.where("n_nationkey < 6").select(F.col("n_nationkey").alias("r"), F.concat_ws("", F.lit("/api/"), F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "/{key}").otherwise("")).alias("b"))).withColumn("grade", tx.route_match(F.col("a"), F.col("b"))).where("grade is not null").select("l", "r", "grade"))
query("ids_nodes", "IDX-19 SRC-06 EXT-19", "nodes", "SELECT node_id, concat('node:', substr(sha256(concat(repo_id, '|', node_type, '|', qualified_name, '|', coalesce(file_path, ''))), 1, 24)) AS stable_id FROM nodes WHERE repo_id <> 'sales'")(lambda n: n.where("repo_id <> 'sales'").select("node_id", tx.node_id(F.col("repo_id"), F.col("node_type"), F.col("qualified_name"), F.col("file_path")).alias("stable_id")))
query("sar03_cwe_ids", "SAR-03 SAR-04", "part", """WITH p AS (SELECT p_partkey, concat('rule ', p_size, ' CWE-', p_partkey % 130, ' cwe89 ', p_brand) AS t FROM part), c AS (SELECT p_partkey, t, list_sort(list_distinct(list_transform(regexp_extract_all(t, '[0-9]{1,5}'), lambda x: CAST(x AS INT)))) AS n FROM p) SELECT p_partkey, array_to_string(list_transform(n, lambda x: concat('CWE-', x)), ',') AS cwes, CASE list_filter(n, lambda x: x IN (89,79,22,78,798,327,476))[1] WHEN 89 THEN 'sql-injection' WHEN 79 THEN 'xss' WHEN 22 THEN 'path-traversal' WHEN 78 THEN 'command-injection' WHEN 476 THEN 'null-deref' ELSE 'other' END AS family FROM c""")(lambda p: p.select("p_partkey", sa.cwe_ids(F.concat_ws("", F.lit("rule "), F.col("p_size").cast("string"), F.lit(" CWE-"), (F.col("p_partkey") % 130).cast("string"), F.lit(" cwe89 "), "p_brand")).alias("c")).select("p_partkey", F.array_join("c", ",").alias("cwes"), sa.rule_family(F.lit("r"), F.col("c"), F.lit("t")).alias("family")))
query("sar02_severity", "SAR-02 SAR-05", "lineitem", """SELECT tool, level, score, severity, count(*) AS n FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'bandit' WHEN 1 THEN 'sonarqube' ELSE 'semgrep' END AS tool, CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'note' ELSE 'minor' END AS level, CASE WHEN l_quantity > 45 THEN '9.5' WHEN l_quantity > 40 THEN '7.1' WHEN l_quantity > 35 THEN 'bad' END AS score FROM lineitem) x, LATERAL (SELECT CASE WHEN score = '9.5' THEN 'critical' WHEN score = '7.1' THEN 'high' WHEN tool = 'bandit' THEN 'low' WHEN tool = 'sonarqube' THEN CASE level WHEN 'minor' THEN 'low' ELSE 'medium' END ELSE CASE level WHEN 'error' THEN 'high' WHEN 'note' THEN 'low' ELSE 'informational' END END AS severity) s GROUP BY ALL""")(lambda li: _severity(li))


def _severity(li):
    x = li.select(F.when(F.col("l_linenumber") % 3 == 0, "bandit").when(F.col("l_linenumber") % 3 == 1, "sonarqube").otherwise("semgrep").alias("tool"), F.when(F.col("l_returnflag") == "A", "error").when(F.col("l_returnflag") == "N", "note").otherwise("minor").alias("level"), F.when(F.col("l_quantity") > 45, "9.5").when(F.col("l_quantity") > 40, "7.1").when(F.col("l_quantity") > 35, "bad").alias("score"))
    return x.withColumn("severity", sa.severity(F.col("tool"), F.col("level"), F.create_map(F.lit("security-severity"), F.col("score")))).groupBy("tool", "level", "score", "severity").agg(F.count("*").alias("n"))


query("fun14_clause_classes", "FUN-14 FUN-15", "documents", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'test|pytest|passes|fails|performance|latency|throughput') THEN 'dynamic' WHEN regexp_matches(lower(text), 'security|secret|credential|injection') THEN 'hybrid' ELSE 'static' END AS checkability, CASE WHEN regexp_matches(lower(text), 'security|secret|credential|injection') THEN 'security' WHEN regexp_matches(lower(text), 'compliance|policy|governance|hc') THEN 'compliance' WHEN regexp_matches(lower(text), 'performance|latency') THEN 'performance' ELSE 'correctness' END AS risk FROM documents")(lambda d: d.select("doc_id", tx.checkability(F.col("text")).alias("checkability"), tx.risk_class(F.col("text")).alias("risk")))
query("fun11_risk_policy", "FUN-10 FUN-11 FUN-12 FUN-29 FUN-33", "lineitem", """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 48 THEN 1 WHEN l_discount > 0.09 THEN 2 WHEN l_tax > 0.07 THEN 3 WHEN l_quantity < 3 THEN 4 WHEN l_linenumber = 5 THEN 5 WHEN l_returnflag = 'R' THEN 6 WHEN l_linenumber = 6 THEN 7 ELSE 8 END AS k FROM lineitem) SELECT k8 AS action, risk, count(*) AS n FROM (SELECT CASE WHEN k <= 4 THEN 'reject' WHEN k <= 7 THEN 'needs_human_review' ELSE 'approve' END AS k8, CASE k WHEN 1 THEN 'vulnerability_introducing' WHEN 2 THEN 'correct_but_overfit' WHEN 3 THEN 'vulnerable' WHEN 8 THEN 'safe' ELSE 'unknown' END AS risk FROM r) GROUP BY ALL""")(lambda li: li.select(tx.risk_policy(F.col("l_quantity") > 48, F.col("l_discount") > 0.09, F.col("l_tax") > 0.07, F.col("l_quantity") < 3, F.when(F.col("l_linenumber") == 5, "trace-incomplete").otherwise("ok"), F.col("l_returnflag") == "R", F.col("l_linenumber") == 6).alias("p")).select(tx.merge_recommendation(F.col("p.action")).alias("action"), "p.risk").groupBy("action", "risk").agg(F.count("*").alias("n")))
query("fun20_snippets", "FUN-20", "documents", "SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:3], chr(10))) AS digest FROM documents")(lambda d: d.select("doc_id", F.md5(tx.bounded_snippet(F.col("text"), 3)).alias("digest")))
query("set06_union_all", "SET-06", "nodes", "SELECT node_id, count(*) AS n FROM (SELECT node_id FROM nodes WHERE file_path = 'src/crm/c3.py' UNION ALL SELECT node_id FROM nodes WHERE label = 'Customer#000000003' OR file_path = 'src/crm/c3.py') GROUP BY node_id")(lambda n: n.where("file_path = 'src/crm/c3.py'").select("node_id").unionByName(n.where("label = 'Customer#000000003' or file_path = 'src/crm/c3.py'").select("node_id")).groupBy("node_id").agg(F.count("*").alias("n")))
query("set07_ordered_distinct", "SET-07 SET-08", "conversations", "WITH w AS (SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations) SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM w WHERE turn = f GROUP BY conv_id")(lambda c: c.groupBy("conv_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("r")).select("conv_id", F.array_join("r", ",").alias("roles")))
query("agg36_invalidation", "AGG-36 STR-06 AGG-25", "nodes", "SELECT repo_id, count(*) FILTER (snapshot_id <> 'snap:1' OR coalesce(contains(file_path, 'c3'), false)) AS stale, count(*) AS entries FROM nodes GROUP BY repo_id")(lambda n: n.groupBy("repo_id").agg(F.count_if((F.col("snapshot_id") != "snap:1") | F.coalesce(F.col("file_path").contains("c3"), F.lit(False))).alias("stale"), F.count("*").alias("entries")))
query("str01_debounced_batches", "STR-01", "events", """WITH g AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id AS repo_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS flush_ts, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths, count(*) AS events FROM s GROUP BY user_id, k""")(lambda e: mo.debounce(e.select(F.col("user_id").alias("repo_id"), F.col("event_type").alias("path"), "ts"), "6 hours").withColumn("paths", F.array_join("paths", ",")))

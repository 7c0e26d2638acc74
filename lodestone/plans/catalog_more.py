"""Queries of their own for rows that others had carried along, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import answers as an
from lodestone.operators import evaluation as evl
from lodestone.operators import graph as gr
from lodestone.operators import ledger as lg
from lodestone.operators import ranking as rk
from lodestone.operators import registry as rg
from lodestone.operators import sarif as sa
from lodestone.operators import stores as st
from lodestone.plans.catalog import _BR
from lodestone.plans.catalog_sources import _texts, _written
from lodestone.plans.registry import query
from lodestone.sources import evidence as ev

# --- graph --------------------------------------------------------------------------------------

_POLICY = " ".join(f"WHEN '{k}' THEN {h}" for k, (h, _) in gr.POLICIES.items())
_TYPES = " ".join(f"WHEN '{k}' THEN '{','.join(sorted(t))}'" for k, (_, t) in gr.POLICIES.items())
_CHANGE = "c AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'internal_implementation' WHEN 1 THEN 'public_api_change' WHEN 2 THEN 'idl_schema_contract_change' WHEN 3 THEN 'security_sensitive_change' WHEN 4 THEN 'generated_file_change' WHEN 5 THEN 'mixed' WHEN 6 THEN 'unknown' ELSE 'else' END AS change_type FROM pages)"
query("grf08_traversal_policies", "GRF-08", "pages", f"WITH {_CHANGE} SELECT page_id, change_type, CASE change_type {_POLICY} ELSE 3 END AS max_hops, CASE change_type {_TYPES} ELSE '{','.join(sorted(gr.POLICIES['unknown'][1]))}' END AS edge_types FROM c")(lambda p: gr.policies(p.select("page_id", F.element_at(F.array(*map(F.lit, ("internal_implementation", "public_api_change", "idl_schema_contract_change", "security_sensitive_change", "generated_file_change", "mixed", "unknown", "else", "else"))), (F.col("page_id") % 9 + 1).cast("int")).alias("change_type"))).withColumn("edge_types", F.array_join("edge_types", ",")))
query("grf09_reachability", "GRF-09", "cards part", "SELECT alert_id AS node_id, 'sarif_reachability' AS impact_group, 1 AS hop, (SELECT min_by(p_name, p_partkey) FROM part) AS origin, 'analyser' AS confidence, severity = 'high' AS breaking, concat('rule:', rule_id) AS notes FROM cards")(lambda c, p: gr.reachability(c.withColumn("severity", F.when(F.col("severity") == "high", "critical").otherwise(F.col("severity"))), p.select(F.col("p_name").alias("symbol_id"), F.col("p_partkey").alias("place"))))
query("grf10_blast_report", "GRF-10", "edges nodes", f"""WITH {_BR}, h AS (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3 UNION ALL SELECT *, 4 FROM h4 UNION ALL SELECT *, 5 FROM h5)
SELECT 'all' AS what, count(*) AS nodes, min(hop) AS nearest, max(hop) AS farthest FROM h""")(lambda e, n: _report(e, n))


def _report(e, n):
    r = gr.blast_report(*gr.blast_radius(e, n, ["order:1", "order:2", "order:33"], "public_api_change")).where("impact_group <> 'ambiguous'")
    return r.agg(F.lit("all").alias("what"), F.sum("nodes").alias("nodes"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"))


query("grf18_patch_context", "GRF-18", "lineitem", "WITH s AS (SELECT DISTINCT l_orderkey AS diff_id, concat('s', l_partkey % 40) AS symbol_id, bool_or(l_returnflag = 'R') AS b FROM lineitem WHERE l_orderkey % 9 = 0 GROUP BY ALL) SELECT diff_id, string_agg(symbol_id, ',' ORDER BY symbol_id) AS changed, string_agg('caller:' || symbol_id, ',' ORDER BY symbol_id) AS callers, string_agg('test:' || symbol_id, ',' ORDER BY symbol_id) AS tests, coalesce(string_agg(symbol_id, ',' ORDER BY symbol_id) FILTER (b), '') AS boundaries FROM s GROUP BY diff_id")(lambda li: _patch(li))


def _patch(li):
    s = li.where("l_orderkey % 9 = 0").select(F.col("l_orderkey").alias("diff_id"), F.expr("concat('s', l_partkey % 40)").alias("symbol_id"), (F.col("l_returnflag") == "R").alias("is_boundary"))
    return gr.patch_context(s).select("diff_id", *(F.array_join(c, ",").alias(c) for c in ("changed", "callers", "tests", "boundaries")))


# --- ranking ------------------------------------------------------------------------------------

query("agg05_churn", "AGG-05", "orders", "WITH c AS (SELECT concat('f', o_custkey % 300) AS file_path, count(*) AS churn FROM orders GROUP BY 1) SELECT file_path, round(CAST(churn AS DOUBLE) / (SELECT max(churn) FROM c), 9) AS churn FROM c")(lambda o: rk.max_normalised(o.groupBy(F.expr("concat('f', o_custkey % 300)").alias("file_path")).agg(F.count("*").cast("double").alias("churn")), "churn").withColumn("churn", F.round("churn", 9)))
_W = "CASE signal_type WHEN 'keyword' THEN 0.25 WHEN 'sarif' THEN 0.2 WHEN 'blame' THEN 0.15 WHEN 'graph_neighbour' THEN 0.1 END::DOUBLE"
_SIG = f"w AS (SELECT *, {_W} AS w FROM signals), t AS (SELECT repo_id, file_path, signal_type, sum(raw_score * w) AS s, any_value(w) AS w, bool_or(raw_score > 0.3) AS strong, bool_or(is_generated) AS g FROM w GROUP BY ALL), x AS (SELECT repo_id, file_path, bool_or(g) AS is_generated, count(*) AS types, round(least(sum(s) / sum(w), 1.0), 9) AS score, count(*) FILTER (strong)::DOUBLE / count(*) AS agreement FROM t GROUP BY repo_id, file_path)"
query("agg08_agreement", "AGG-08", "signals", f"WITH {_SIG} SELECT file_path, round(agreement, 9) AS agreement FROM x WHERE score >= 0.05")(lambda s: rk.merge_signals(s).select("file_path", F.round("agreement", 9).alias("agreement")))
query("top01_ranked_files", "TOP-01", "signals", f"WITH {_SIG} SELECT file_path, types FROM x WHERE score >= 0.05 ORDER BY is_generated, types DESC, score DESC, repo_id, file_path LIMIT 8")(lambda s: rk.merge_signals(s, most=8).select("file_path", "types"))
query("rnk07_recency", "RNK-07", "orders", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE exp(-greatest((epoch(TIMESTAMP '1998-12-01') - floor(epoch(o_orderdate))) / 3600.0, 0)::DOUBLE / 168) END, 9) AS recency FROM orders")(lambda o: o.select("o_orderkey", F.round(rk.recency(F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")), F.expr("timestamp'1998-12-01 00:00:00'")), 9).alias("recency")))
_ISSUE = "concat('# Title\\nSee https://x.org/a/', n_nationkey, ' *now* with `Pkg.mod', n_regionkey, '` in src/a', n_nationkey, '.py\\n## Expected result\\nworks ', n_name, '\\n## Actual\\nValueError: bad_name', n_regionkey, '\\n\\n## expected\\nlater ', n_nationkey)"
query("rnk01_issue_texts", "RNK-01", "nation", "SELECT n_nationkey, lower(concat('title see x.org now with pkg.mod', n_regionkey, ' in src/a', n_nationkey, '.py expected result works ', replace(n_name, '_', ' '), ' actual valueerror: bad name', n_regionkey, ' expected later ', n_nationkey)) AS plain, concat('src/a', n_nationkey, '.py') AS files, concat('ValueError: bad_name', n_regionkey) AS errors, contains(lower(n_name), 'cwe') AS security FROM nation")(lambda n: n.select("n_nationkey", F.expr(_ISSUE).alias("t")).select("n_nationkey", tx.plain_issue(F.col("t")).alias("plain"), F.array_join(F.filter(tx.issue_files(F.col("t")), lambda f: f.contains("/")), ",").alias("files"), F.array_join(tx.error_lines(F.col("t")), ",").alias("errors"), F.col("t").rlike("(?i)cwe|vulnerab|injection").alias("security")))
query("win12_issue_sections", "WIN-12", "nation", "SELECT n_nationkey AS issue_id, unnest(['expected', 'actual']) AS section, unnest([concat('later ', n_nationkey), concat('ValueError: bad_name', n_regionkey)]) AS body FROM nation")(lambda n: tx.issue_sections(n.select(F.col("n_nationkey").alias("issue_id"), F.expr(_ISSUE).alias("text"))))
query("rnk16_confidence", "RNK-16", "customer nodes", "SELECT 'crm' AS repo_id, count(*) AS questions, count(*) FILTER (c_custkey % 3 > 0) AS answered FROM customer")(lambda c, n: an.answers(c.select(F.col("c_custkey").alias("question_id"), F.lit("crm").alias("repo_id"), F.concat(F.lit("What route or api is `"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise("zz"), F.lit("`")).alias("text")), n).agg(F.lit("crm").alias("repo_id"), F.count("*").alias("questions"), F.count_if(F.col("confidence") != "unknown").alias("answered")))

# --- alerts, verdicts, ledgers ------------------------------------------------------------------

query("jon05_file_nodes", "JON-05", "cards nodes", "WITH n AS (SELECT file_path, min(node_id) AS file_node FROM nodes WHERE repo_id = 'geo' AND node_type IN ('file', 'module') GROUP BY 1) SELECT alert_id, file_node FROM (SELECT alert_id, concat('src/geo/n', line % 7, '.py') AS f FROM cards) LEFT JOIN n ON f = n.file_path")(lambda c, n: sa.file_nodes(c.select("alert_id", F.expr("concat('src/geo/n', line % 7, '.py')").alias("file_path")), n, "geo"))
query("jon17_clause_verdicts", "JON-17", "part labels", "SELECT p_partkey AS clause_id, coalesce(CASE WHEN quality = 1 THEN 'satisfied' WHEN quality = 0 THEN 'violated' END, 'unknown') AS verdict FROM part LEFT JOIN labels ON p_partkey = doc_id")(lambda p, l: _verdicts(p, l))


def _verdicts(p, labels):
    v = labels.select(F.col("doc_id").alias("clause_id"), F.when(F.col("quality") == 1, "satisfied").otherwise("violated").alias("verdict"))
    m = evl.verdict_matrix(p.select(F.col("p_partkey").alias("clause_id")), v, "clause_id")
    return m.select("clause_id", F.when(F.col("satisfied") > 0, "satisfied").when(F.col("violated") > 0, "violated").otherwise("unknown").alias("verdict"))


query("fun18_ece_buckets", "FUN-18", "samples", "SELECT sample_id, CASE WHEN predicted_probability >= 0.9 THEN 'high_confidence' WHEN predicted_probability >= 0.7 THEN 'medium_confidence' ELSE 'low_confidence' END AS bucket FROM samples")(lambda s: s.select("sample_id", evl.ece_bucket(F.col("predicted_probability")).alias("bucket")))
query("fun19_budget_status", "FUN-19", "run_events", "WITH r AS (SELECT run_id, seq, sum(token_count) OVER (PARTITION BY run_id ORDER BY seq) AS t FROM run_events) SELECT run_id, seq, CASE WHEN t >= 20000 THEN 'hard_stop' WHEN t >= 16000 THEN 'soft_warning' ELSE 'ok' END AS status FROM r")(lambda e: lg.running_budget(e, 20_000, None).select("run_id", "seq", "status"))
query("fun22_canonical_json", "FUN-22 FUN-21", "events", "SELECT event_id, concat('{\"a\":[1,', user_id, '],\"z\":\"', event_type, '\"}') AS json, substr(sha256(concat('{\"a\":[1,', user_id, '],\"z\":\"', event_type, '\"}')), 1, 24) AS hash FROM events")(lambda e: e.select("event_id", F.expr("concat('{ \"z\": \"', event_type, '\", \"a\": [1, ', user_id, '] }')").alias("t")).select("event_id", tx.canonical_json(F.col("t")).alias("json"), tx.payload_hash(F.col("t")).alias("hash")))
query("str05_replay", "STR-05", "events", """WITH c AS (SELECT event_type AS resource, max(ts) - INTERVAL 2 DAY AS last_ts FROM events GROUP BY 1), g AS (SELECT c.resource, count(*) FILTER (e.ts > last_ts) AS missed FROM c JOIN events e ON e.event_type = c.resource GROUP BY 1) SELECT 'me' AS client, resource, CASE WHEN missed = 0 THEN 'none' ELSE 'replay' END AS action, missed AS replayed FROM g""")(lambda e: lg.recover(e.groupBy(F.col("event_type").alias("resource")).agg((F.max("ts") - F.expr("INTERVAL 2 DAY")).alias("last_ts")).withColumn("client", F.lit("me")), e.select(F.col("event_type").alias("resource"), "ts"), F.expr("timestamp'2024-02-01 00:00:00'"), 1 << 30))
query("ext15_pending_migrations", "EXT-15", "nation", "SELECT n_nationkey AS version, n_name AS checksum FROM nation WHERE n_nationkey % 3 = 1")(lambda n: st.pending_migrations(n.select(F.col("n_nationkey").alias("version"), F.col("n_name").alias("checksum")), n.where("n_nationkey % 3 <> 1").select(F.col("n_nationkey").alias("version"))))

# --- sources and registries ---------------------------------------------------------------------


def _ctags(n):
    tag = "concat('{\"_type\": \"tag\", \"name\": \"f', n_nationkey, '\", \"path\": \"src/', n_regionkey, '.py\", \"kind\": \"member\", \"line\": ', n_nationkey + 1, ', \"scope\": \"K\", \"language\": \"Python\"}\\n{\"_type\": \"tag\", \"name\": \"K.f', n_nationkey, '\", \"path\": \"src/', n_regionkey, '.py\", \"kind\": \"member\", \"line\": 1, \"scope\": \"K\"}\\n{\"_type\": \"ptag\", \"name\": \"JSON_OUTPUT_VERSION\"}')"
    return ev.read_ctags(n.sparkSession, _written(n.select(F.expr(tag).alias("value")), "ctags"))


query("idx06_ctags", "IDX-06", "nation", "SELECT concat('src/', n_regionkey, '.py') AS path, concat('f', n_nationkey) AS name, concat('K.f', n_nationkey) AS qualified, 'member' AS kind, n_nationkey + 1 AS line, n_nationkey + 1 AS \"end\" FROM nation")(_ctags)


def _sonar(n):
    doc = "concat('{\"issues\": [{\"rule\": \"py:S', n_regionkey, '\", \"component\": \"proj:src/', n_nationkey, '.py\", \"line\": ', n_nationkey, ', \"message\": \"', n_name, '\", \"severity\": \"', CASE n_nationkey % 4 WHEN 0 THEN 'BLOCKER' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'MAJOR' ELSE 'MINOR' END, '\"}]}')"
    return ev.sonar_to_alerts(n.sparkSession, _written(n.select(F.col("n_nationkey").alias("k"), F.expr(doc).alias("value")), "sonar", "k"))


query("src10_sonar_alerts", "SRC-10", "nation", "SELECT 'sonarqube' AS analyser_id, concat('py:S', n_regionkey) AS rule_id, concat('src/', n_nationkey, '.py') AS file_path, n_nationkey AS start_line, n_name AS message, CASE n_nationkey % 4 WHEN 2 THEN 'warning' WHEN 3 THEN 'note' ELSE 'error' END AS level FROM nation")(_sonar)


def _mixed(n):
    return _texts(n, "concat('a', n_nationkey, '.py')", "concat('class K', n_nationkey, ':\\n    def m(self):\\n        pass\\n')").unionByName(_texts(n, "concat('b', n_nationkey, '.ts')", "concat('export class T', n_nationkey, ' {}\\n')"))


query("ext01_index_backends", "EXT-01 EXT-02", "nation", "SELECT concat('a', n_nationkey, '.py') AS path, unnest(['class', 'method']) AS kind, unnest([concat('K', n_nationkey), 'm']) AS name, 'python' AS backend FROM nation UNION ALL SELECT concat('b', n_nationkey, '.ts'), 'class', concat('T', n_nationkey), 'typescript' FROM nation")(lambda n: rg.backends().run(_mixed(n)).select("path", "kind", "name", "backend"))
query("ext02_backend_capabilities", "EXT-02", "nation", "SELECT * FROM (VALUES ('cpp', 'heuristic', false), ('java', 'heuristic', true), ('python', 'parser', true), ('typescript', 'heuristic', true)) t(name, confidence, enabled)")(lambda n: _capabilities(n.sparkSession))


def _capabilities(spark):
    r = rg.backends()
    r.reload(list(r.entries.values()), {"cpp"})
    return r.describe(spark).select("name", "confidence", "enabled")


query("ext03_plugin_contracts", "EXT-03 EXT-04", "nation", "SELECT concat('w', n_nationkey, '.py') AS path, 'handles' AS role, concat('join', n_regionkey) AS name, 'websocket' AS backend FROM nation UNION ALL SELECT concat('x', n_nationkey, '.proto'), 'exposes', concat('S', n_nationkey, '/Get'), 'grpc' FROM nation")(lambda n: _contracts(n))


def _contracts(n):
    r = rg.plugins()
    r.reload([e for k, e in r.entries.items() if k != "http"], {"mqtt"})
    files = _texts(n, "concat('w', n_nationkey, '.py')", "concat('@sio.on(\"join', n_regionkey, '\")\\ndef f(): pass')").unionByName(_texts(n, "concat('x', n_nationkey, '.proto')", "concat('service S', n_nationkey, ' { rpc Get(K) returns (V); }')"))
    return r.run(files).select("path", "role", "name", "backend")


query("ext09_resources", "EXT-09 EXT-08", "nodes edges runs links", "SELECT node_id AS id FROM nodes WHERE repo_id = 'crm' AND node_type = 'class' UNION ALL SELECT edge_id FROM edges WHERE repo_id = 'sales' AND edge_type = 'calls' UNION ALL SELECT run_id FROM runs WHERE run_id = 'run:7' UNION ALL SELECT run_id FROM links WHERE incident_id = 'inc:3'")(lambda n, e, r, k: _resources({"nodes": n, "edges": e, "runs": r, "links": k}))


def _resources(tables):
    out = None
    for uri in ("graph://crm/nodes/class", "graph://sales/edges/calls", "run://run:7", "incident://inc:3/runs"):
        df = rg.resource(tables, uri)
        df = df.select(F.col(df.columns[0]).alias("id"))
        out = df if out is None else out.unionByName(df)
    return out

"""Queries over governance files, repair, stores, reviews, memory and answers, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import answers as an
from lodestone.operators import graph as gr
from lodestone.operators import harness as hs
from lodestone.operators import memory as me
from lodestone.operators import ranking as rk
from lodestone.operators import repair as rp
from lodestone.operators import review as rv
from lodestone.operators import sarif as sa
from lodestone.operators import stores as st
from lodestone.operators.ledger import retained
from lodestone.plans.catalog import EXPAND, keyword_sql
from lodestone.plans.registry import query

AS_OF = "timestamp'2024-01-20 00:00:00'"


def _joined(c: str, by: str = ",") -> F.Column:
    return F.array_join(c, by).alias(c)


# --- governance files ---------------------------------------------------------------------------

_SIGNALS = """s AS (SELECT repo_id, bool_or(path LIKE 'src/%') AS src, bool_or(path LIKE 'tests/%') AS tests, bool_or(path = 'Makefile') AS make, bool_or(path = 'pyproject.toml') AS project, bool_or(path LIKE '.github/workflows/%' OR path IN ('tox.ini', '.pre-commit-config.yaml')) AS ci, bool_or(path = 'AGENTS.md') AS manifest FROM repo_files GROUP BY repo_id),
g AS (SELECT repo_id, CASE WHEN src AND tests AND make AND project AND ci AND manifest THEN 'S3' WHEN src AND tests AND (ci OR make OR project) THEN 'S2' WHEN src OR make OR project THEN 'S1' ELSE 'S0' END AS stage FROM s)"""
_DRIFT = """m AS (SELECT repo_id, content AS manifest FROM repo_files WHERE path = 'AGENTS.md'), r AS (SELECT DISTINCT repo_id FROM repo_files),
o AS (SELECT f.repo_id, path AS artefact, content, manifest FROM repo_files f LEFT JOIN m ON f.repo_id = m.repo_id WHERE path IN ('CLAUDE.md', '.github/copilot-instructions.md', '.codex/INSTRUCTIONS.md')),
ln AS (SELECT repo_id, artefact, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM o),
pt AS (SELECT * FROM (VALUES (1, 'allow\\s+all'), (2, 'no\\s+restrictions'), (3, 'skip.*hc[1-6]'), (4, 'disable.*constraint'), (5, 'ignore.*hard\\s+constraint')) t(k, p)),
hit AS (SELECT repo_id, artefact, k, n, concat('line ', n, ': ', trim(x)) AS e FROM ln, pt WHERE regexp_matches(x, p, 'i')),
ev AS (SELECT repo_id, artefact, array_to_string(list_slice(list(e ORDER BY k, n), 1, 5), ',') AS evidence FROM hit GROUP BY repo_id, artefact),
sk AS (SELECT repo_id, string_split(path, '/')[3] AS name, bool_or(path LIKE '.agents/skills/%/SKILL.md') AS ok FROM repo_files WHERE path LIKE '.agents/skills/%/%' GROUP BY 1, 2),
ci AS (SELECT repo_id, count(*) FILTER (path LIKE '%.yml' OR path LIKE '%.yaml') AS n FROM repo_files WHERE path LIKE '.github/workflows/%' GROUP BY repo_id),
lack AS (SELECT repo_id, array_to_string(list_filter(['HC1','HC2','HC3','HC4','HC5','HC6'], lambda h: NOT contains(manifest, h)), ',') AS evidence FROM m),
d AS (SELECT r.repo_id, 'AGENTS.md' AS artefact, CASE WHEN manifest IS NULL THEN 'missing' WHEN l.evidence <> '' THEN 'stale' ELSE 'clean' END AS status, coalesce(l.evidence, '') AS evidence FROM r LEFT JOIN m ON r.repo_id = m.repo_id LEFT JOIN lack l ON r.repo_id = l.repo_id
UNION ALL SELECT o.repo_id, o.artefact, CASE WHEN ev.evidence IS NOT NULL THEN 'relaxed' WHEN coalesce(manifest, '') <> '' AND NOT contains(content, 'HC') AND NOT contains(lower(content), 'hard constraint') AND regexp_matches(content, 'allow|deny|permission|tool|mode', 'i') THEN 'stale' ELSE 'clean' END, coalesce(ev.evidence, '') FROM o LEFT JOIN ev ON o.repo_id = ev.repo_id AND o.artefact = ev.artefact
UNION ALL SELECT repo_id, concat('.agents/skills/', name, '/SKILL.md'), CASE WHEN ok THEN 'clean' ELSE 'missing' END, '' FROM sk
UNION ALL SELECT repo_id, '.agents/skills/', 'missing', '' FROM m WHERE contains(manifest, '.agents/skills') AND repo_id NOT IN (SELECT repo_id FROM repo_files WHERE path LIKE '.agents/skills/%')
UNION ALL SELECT r.repo_id, '.github/workflows/', CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'stale' ELSE 'clean' END, '' FROM r LEFT JOIN ci ON r.repo_id = ci.repo_id)"""
_GATES = "gt AS (SELECT * FROM (VALUES ('S1','Makefile'),('S2','Makefile'),('S2','pyproject.toml'),('S2','.pre-commit-config.yaml'),('S3','Makefile'),('S3','pyproject.toml'),('S3','.pre-commit-config.yaml'),('S3','.github/workflows'),('S3','.secrets.baseline'),('S3','AGENTS.md')) t(stage, subject))"

query("agg42_harness_stage", "AGG-42", "repo_files", f"WITH {_SIGNALS} SELECT repo_id, stage FROM g")(lambda f: hs.stages(f))
query("fun23_harness_drift", "FUN-23", "repo_files", f"WITH {_DRIFT} SELECT repo_id, artefact, status, evidence FROM d")(lambda f: hs.drift(f).select("repo_id", "artefact", "status", _joined("evidence")))
query("fun24_required_drift", "FUN-24", "repo_files", f"""WITH {_SIGNALS}, q AS (SELECT * FROM (VALUES (0,'AGENTS.md'),(1,'CLAUDE.md'),(1,'.pre-commit-config.yaml'),(2,'.github/workflows/verify.yml'),(2,'.secrets.baseline'),(3,'.github/workflows/governance.yml')) t(least, artefact))
SELECT g.repo_id, q.artefact, CASE WHEN content IS NULL THEN 'missing' WHEN regexp_matches(content, 'ignore_missing_secrets|skip_hc|disable_hc|no_secrets_scan|allow_all') THEN 'relaxed' WHEN q.artefact = 'AGENTS.md' AND NOT contains(content, 'managed-section:auto') THEN 'stale' ELSE 'clean' END AS drift_class
FROM g JOIN q ON CAST(substr(stage, 2, 1) AS INT) >= least LEFT JOIN repo_files f ON f.repo_id = g.repo_id AND f.path = q.artefact""")(lambda f: hs.required_drift(f, hs.stages(f)))
query("agg43_harness_controls", "AGG-43 FUN-24", "repo_files readiness_scores", f"""WITH {_SIGNALS}, {_DRIFT}, {_GATES}
SELECT repo_id, CASE WHEN status = 'stale' THEN 'drift' ELSE 'manifest_relaxation' END AS category, CASE WHEN status = 'stale' THEN 'warning' ELSE 'error' END AS severity, artefact AS subject FROM d WHERE status IN ('stale', 'relaxed') OR (status = 'missing' AND artefact = 'AGENTS.md')
UNION ALL SELECT repo_id, 'readiness_regression', CASE WHEN current < baseline THEN 'error' ELSE 'info' END, 'readiness' FROM readiness_scores WHERE baseline IS NOT NULL AND current IS NOT NULL
UNION ALL SELECT g.repo_id, 'verify_gate', 'error', gt.subject FROM g JOIN gt ON g.stage = gt.stage WHERE NOT EXISTS (SELECT 1 FROM repo_files f WHERE f.repo_id = g.repo_id AND (f.path = gt.subject OR f.path LIKE gt.subject || '/%'))""")(lambda f, s: hs.validate(f, s))
query("agg31_ai_readiness", "AGG-31", "repo_files readiness_scores", """WITH s AS (SELECT repo_id, CASE WHEN bool_or(path = 'AGENTS.md') THEN 5 ELSE 0 END AS agent_config, CAST(least(floor(count(*) FILTER (regexp_matches(path, '^docs/[^/]+\\.md$')) / 2), 5) AS INT) AS documentation, CASE WHEN bool_or(path = 'Makefile') THEN 4 ELSE 1 END AS ci_cd, CASE WHEN bool_or(path LIKE 'src/%') AND bool_or(path LIKE 'tests/%') THEN 4 ELSE 1 END AS code_structure, CASE WHEN bool_or(path = 'pyproject.toml') THEN 4 ELSE 1 END AS security FROM repo_files GROUP BY repo_id), t AS (SELECT *, agent_config + documentation + ci_cd + code_structure + security AS total FROM s)
SELECT t.*, total >= 18 AND least(agent_config, documentation, ci_cd, code_structure, security) >= 3 AS met, coalesce(total - baseline % 25, 0) AS delta, coalesce(total - baseline % 25, 0) >= 0 AS no_regression FROM t LEFT JOIN readiness_scores r ON t.repo_id = r.repo_id""")(lambda f, s: rv.ai_readiness(f, s.select("repo_id", (F.col("baseline") % 25).alias("total"))))

# --- repair -------------------------------------------------------------------------------------

_FAM = "CASE WHEN contains(lower(rule_id), 'sql') OR contains(lower(rule_id), 'injection') OR contains(lower(rule_id), 'cwe-89') THEN 'injection' WHEN contains(lower(rule_id), 'null') OR contains(lower(rule_id), 'none') THEN 'nullderef' ELSE string_split(lower(rule_id), '.')[1] END"
_PRED = "CASE rule_family WHEN 'injection' THEN 'untrusted input reaches command or query sink' WHEN 'nullderef' THEN 'nullable value is dereferenced without a guard' ELSE 'rule predicate fired' END"
_NEG = "CASE rule_family WHEN 'injection' THEN 'input is validated or parameterized before the sink' WHEN 'nullderef' THEN 'value is checked for null before dereference' END"
_CARD = f"b AS (SELECT *, {_FAM} AS rule_family, CASE WHEN file_path IS NOT NULL AND line <> 0 THEN 'parser' ELSE 'heuristic' END AS confidence FROM cards)"
_CLASS = "CASE WHEN suppressed THEN 'likely_false_positive' WHEN severity IN ('low','informational') THEN 'needs_review' ELSE 'likely_true_positive' END"

query("sar10_repair_bindings", "SAR-10", "cards", f"WITH {_CARD} SELECT alert_id, rule_family, concat('file:', file_path) AS file_node_id, CASE WHEN confidence = 'parser' THEN concat('symbol:', file_path, ':', line) END AS symbol_node_id, confidence, CASE WHEN file_path IS NULL THEN 'no_location,stale_or_missing_snapshot' ELSE 'stale_or_missing_snapshot' END AS diagnostics FROM b".replace("concat('file:', file_path) AS", "'file:' || file_path AS"))(lambda a: rp.bindings(a).select("alert_id", "rule_family", "file_node_id", "symbol_node_id", "confidence", _joined("diagnostics")))
query("sar15_predicates", "SAR-15", "cards", f"WITH {_CARD} SELECT alert_id, rule_id, rule_family, {_PRED} AS predicate, {_NEG} AS negated, CASE WHEN rule_family = 'injection' THEN 'error' ELSE 'warning' END AS severity, CASE WHEN {_NEG} IS NULL THEN 'heuristic' ELSE 'analyser' END AS confidence, CASE WHEN {_NEG} IS NULL THEN 0 ELSE 1 END AS examples FROM b")(lambda a: rp.predicates(rp.bindings(a)))
query("sar14_suppressions", "SAR-14", "cards", f"WITH {_CARD} SELECT alert_id, rule_id, concat('suppress ', rule_id, ': reviewed false positive') AS annotation, true AS reviewer_required FROM b WHERE suppressed AND confidence IN ('parser', 'analyser')")(lambda a: rp.suppressions(sa.classify(rp.bindings(a)).select("alert_id", "rule_id", "classification", "confidence")))
query("sar13_remaining_risk", "SAR-13", "cards", f"WITH {_CARD}, v AS (SELECT *, cwe IS NOT NULL OR rule_family IN ('injection', 'nullderef') AS vulnerable FROM b) SELECT alert_id, CASE WHEN gone AND tests_passed AND NOT vulnerable THEN 'none' WHEN gone THEN CASE WHEN vulnerable THEN 'medium' ELSE 'low' END ELSE 'high' END AS risk FROM v")(lambda a: rp.bindings(a).select("alert_id", rp.remaining_risk(F.col("gone"), F.col("tests_passed"), F.col("cwe").isNotNull() | F.col("rule_family").isin("injection", "nullderef"), F.lit(False)).alias("risk")))
_CORPUS = "c AS (SELECT DISTINCT concat('ex:', rule_id) AS example_id, rule_id, CASE WHEN contains(rule_id, 'CWE') THEN 'input is validated or parameterized before the sink' ELSE 'value is checked for null before dereference' END AS negated FROM cards WHERE rule_id <> 'style.Rule.x')"
query("sar11_corpus_examples", "SAR-11", "cards", f"WITH {_CARD}, a AS (SELECT alert_id, rule_id, rule_family, {_NEG} AS negated FROM b), {_CORPUS} SELECT alert_id, example_id, 'predicate_negation' AS method FROM a JOIN c ON a.rule_id = c.rule_id AND a.negated = c.negated UNION ALL SELECT alert_id, example_id, 'rule_family_match' FROM a JOIN c ON contains(lower(c.rule_id), rule_family)")(lambda a: rp.examples(rp.predicates(rp.bindings(a)), a.where("rule_id <> 'style.Rule.x'").select(F.concat(F.lit("ex:"), "rule_id").alias("example_id"), "rule_id", F.when(F.col("rule_id").contains("CWE"), "input is validated or parameterized before the sink").otherwise("value is checked for null before dereference").alias("negated")).distinct()))
query("sar12_repair_reports", "SAR-12", "cards", f"""WITH {_CARD}, v AS (SELECT *, cwe IS NOT NULL OR rule_family IN ('injection', 'nullderef') AS vulnerable, gone AND line % 2 = 0 AS clean FROM b), w AS (SELECT *, CASE WHEN clean AND tests_passed AND NOT vulnerable THEN 'none' WHEN clean THEN CASE WHEN vulnerable THEN 'medium' ELSE 'low' END ELSE 'high' END AS risk FROM v),
x AS (SELECT alert_id, risk, CASE WHEN suppressed THEN 'false_positive_suppressed' WHEN clean AND tests_passed THEN CASE WHEN risk = 'none' THEN 'alert_fixed' ELSE 'alert_fixed_with_risk' END WHEN clean THEN 'tests_failed' ELSE 'alert_not_fixed' END AS verdict FROM w)
SELECT alert_id, verdict, verdict IN ('alert_fixed', 'alert_fixed_with_risk', 'false_positive_suppressed') AS success, risk, CASE WHEN risk <> 'none' THEN 'review-required' ELSE 'merge-supporting' END AS recommendation FROM x""")(lambda a: rp.reports(rp.bindings(a).select("alert_id", "cwe", "rule_family"), a.select("alert_id", "gone", (F.col("line") % 2).alias("new_alerts"), "tests_passed", "suppressed")))
query("sar16_run_resource", "SAR-16", "cards", "WITH p AS (SELECT sarif_run, severity, count(*) AS n FROM cards GROUP BY 1, 2), l AS (SELECT sarif_run, string_agg(concat(severity, '=', n), ',' ORDER BY concat(severity, '=', n)) AS severities FROM p GROUP BY 1) SELECT c.sarif_run, count(*) AS alert_count, count(DISTINCT rule_id) AS rule_count, count(DISTINCT coalesce(file_path, '<unresolved>')) AS files, any_value(severities) AS severities FROM cards c JOIN l ON c.sarif_run = l.sarif_run GROUP BY 1")(lambda a: rp.run_resource(a, "sarif_run"))

# --- stores -------------------------------------------------------------------------------------

_LIVE = f"(expires_ts IS NULL OR expires_ts > {AS_OF.replace('timestamp', 'TIMESTAMP ')})"

query("flt10_artifacts", "FLT-10", "artifacts", "SELECT artifact_id, kind FROM artifacts WHERE repo_id = 'repo:3' AND kind = 'trace' ORDER BY artifact_id LIMIT 40")(lambda a: st.listed(a, [F.asc("artifact_id")], 40, repo_id="repo:3", run_id=None, kind="trace").select("artifact_id", "kind"))
query("ext19_artifact_hashes", "EXT-19", "artifacts orders", "SELECT artifact_id, CASE WHEN digest IS NULL THEN true ELSE coalesce(digest = d, false) END AS matched, digest AS expected, CASE WHEN digest IS NOT NULL THEN d END AS actual FROM artifacts LEFT JOIN (SELECT concat('art:', o_orderkey) AS id, md5(concat('body ', o_orderkey)) AS d FROM orders WHERE o_orderkey % 5 <> 0) o ON artifact_id = id")(lambda a, o: st.hash_check(a, o.where("o_orderkey % 5 <> 0").select(F.concat(F.lit("art:"), "o_orderkey").alias("artifact_id"), F.md5(F.concat(F.lit("body "), "o_orderkey")).alias("digest"))))
query("flt25_checksums", "FLT-25", "part", "SELECT p_partkey AS version, p_brand AS stored, concat('Brand#', 10 + p_partkey % 50) AS expected FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND p_brand <> concat('Brand#', 10 + p_partkey % 50)")(lambda p: st.checksum_mismatches(p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("version"), F.col("p_brand").alias("checksum")), p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("version"), F.concat(F.lit("Brand#"), 10 + F.col("p_partkey") % 50).alias("checksum"))))
_CACHE = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY arrival DESC) AS k FROM vectors) WHERE k = 1)"


def _cache(v):
    return st.upsert(v.where("arrival % 2 = 0"), v.where("arrival % 2 <> 0"), ["cache_key"], "arrival")


query("src30_cache_reads", "SRC-30", "vectors", f"WITH {_CACHE} SELECT v.cache_key, bool_or({_LIVE}) AS hit FROM (SELECT DISTINCT concat('v', arrival % 900) AS cache_key FROM vectors) v LEFT JOIN (SELECT cache_key AS ck, expires_ts FROM c) ON v.cache_key = ck AND {_LIVE} GROUP BY 1".replace("bool_or((expires_ts", "bool_or(ck IS NOT NULL AND (expires_ts"))(lambda v: st.cached(_cache(v), v.select(F.concat(F.lit("v"), (F.col("arrival") % 900).cast("string")).alias("cache_key")).distinct(), F.expr(AS_OF)))
query("src30_cache_invalidation", "SRC-30 STR-06", "vectors", f"WITH {_CACHE} SELECT cache_key, repo_id, file_path, git_sha FROM c WHERE NOT (repo_id = 'repo:2' AND file_path = 'src/f7.py') AND NOT (repo_id = 'repo:4' AND git_sha <> 'sha1')")(lambda v: st.invalidate_stale(st.invalidate_file(_cache(v), "repo:2", "src/f7.py"), "repo:4", "sha1").select("cache_key", "repo_id", "file_path", "git_sha"))
query("src30_cache_purge", "SRC-30", "vectors", f"WITH {_CACHE} SELECT cache_key FROM c WHERE {_LIVE}")(lambda v: st.purge(_cache(v), F.expr(AS_OF)).select("cache_key"))
query("agg25_cache_stats", "AGG-25 SRC-30", "vectors", f"WITH {_CACHE}, s AS (SELECT count(*) AS total, count(*) FILTER ({_LIVE}) AS valid FROM c) SELECT total, valid, total - valid AS stale, (SELECT round(avg(CASE WHEN arrival % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) FROM vectors) AS hit_rate FROM s")(lambda v: st.cache_stats(_cache(v), v.select((F.col("arrival") % 3 == 0).alias("hit")), F.expr(AS_OF)).withColumn("hit_rate", F.round("hit_rate", 6)))
query("src26_delete_run", "SRC-26", "cards", "SELECT 'alerts' AS t, count(*) AS n FROM cards WHERE sarif_run <> 'sr:7' UNION ALL SELECT 'rules', count(*) FROM (SELECT DISTINCT sarif_run, rule_id FROM cards WHERE sarif_run <> 'sr:7') UNION ALL SELECT 'runs', count(DISTINCT sarif_run) FROM cards WHERE sarif_run <> 'sr:7'")(lambda a: _counts(st.without_run({"alerts": a, "rules": a.select("sarif_run", "rule_id").distinct(), "runs": a.select("sarif_run").distinct()}, "sr:7", "sarif_run")))


def _counts(tables):
    out = None
    for k, t in tables.items():
        c = t.agg(F.lit(k).alias("t"), F.count("*").alias("n"))
        out = c if out is None else out.unionByName(c)
    return out


query("src26_deltas", "SRC-26", "cards", "SELECT concat('d:', sarif_run, ':', repo_id) AS delta_id, max(line) AS computed FROM cards GROUP BY 1")(lambda a: st.upsert(_deltas(a.where("gone")), _deltas(a.where("not gone")), ["delta_id"], "computed").select("delta_id", "computed"))


def _deltas(a):
    return a.groupBy(F.concat(F.lit("d:"), "sarif_run", F.lit(":"), "repo_id").alias("delta_id")).agg(F.max("line").alias("computed"))


query("src27_interface_records", "SRC-27", "orders", "WITH r AS (SELECT concat('i', o_custkey) AS interface_id, max_by(o_orderpriority, o_orderkey) AS plugin_id, max_by(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) SELECT interface_id, plugin_id FROM r WHERE s <> 'F' AND plugin_id = '1-URGENT'")(lambda o: st.current_interfaces(o.select(F.concat(F.lit("i"), "o_custkey").alias("interface_id"), F.col("o_orderpriority").alias("plugin_id"), (F.col("o_orderstatus") == "F").alias("superseded"), F.col("o_orderkey").alias("arrival")), "1-URGENT").select("interface_id", "plugin_id"))
query("ext16_registry", "EXT-16", "runs", "SELECT repo_id, max(start_ts) AS seen FROM runs WHERE repo_id <> 'repo:5' GROUP BY repo_id")(lambda r: st.unregister(st.upsert(_seen(r.where("status = 'running'")), _seen(r.where("status <> 'running'")), ["repo_id"], "seen"), "repo:5"))


def _seen(r):
    return r.groupBy("repo_id").agg(F.max("start_ts").alias("seen"))


query("ext18_delete_snapshot", "EXT-18", "nodes edges", "SELECT node_id AS id FROM nodes WHERE NOT (repo_id = 'crm' AND snapshot_id = 'snap:1') UNION ALL SELECT edge_id FROM edges WHERE NOT (repo_id = 'crm' AND snapshot_id = 'snap:1')")(lambda n, e: st.without_snapshot(n, "crm", "snap:1").select(F.col("node_id").alias("id")).unionByName(st.without_snapshot(e, "crm", "snap:1").select(F.col("edge_id").alias("id"))))
query("ext17_harness_metadata", "EXT-17", "part", "SELECT p_brand AS component, max_by(p_name, struct_pack(a := p_size, b := p_partkey)) AS digest FROM part GROUP BY 1")(lambda p: st.upsert(_parts(p.where("p_partkey % 2 = 0")), _parts(p.where("p_partkey % 2 = 1")), ["component"], "k").select("component", F.col("k.p_name").alias("digest")))


def _parts(p):
    return p.groupBy(F.col("p_brand").alias("component")).agg(F.max(F.struct("p_size", "p_partkey", "p_name")).alias("k"))


query("ext20_append_records", "EXT-20", "runs", "SELECT run_id, parent_id FROM runs WHERE status <> 'failed' OR CAST(substr(run_id, 5) AS BIGINT) % 3 = 0")(lambda r: st.appended(r.where("status <> 'failed'"), r.where("CAST(substr(run_id, 5) AS BIGINT) % 3 = 0"), "run_id").select("run_id", "parent_id"))
query("ext14_export_delete", "EXT-14", "runs", "SELECT run_id, workflow, cost, true AS exported FROM runs WHERE repo_id = 'repo:3' UNION ALL SELECT run_id, workflow, NULL, false FROM runs WHERE repo_id <> 'repo:3'")(lambda r: _privacy(*st.export_and_delete(r, F.col("repo_id") == "repo:3", ["parent_id"])))


def _privacy(export, rest):
    out = export.select("run_id", "workflow", "cost", F.lit(True).alias("exported"))
    return out.unionByName(rest.select("run_id", "workflow", F.lit(None).cast("double").alias("cost"), F.lit(False).alias("exported")))


query("src28_memory_documents", "SRC-28", "memories", "SELECT repo_id, max(trajectory_id) AS trajectory_id FROM memories GROUP BY repo_id")(lambda m: st.upsert(m.where("trajectory_id % 2 = 0"), m.where("trajectory_id % 2 <> 0"), ["repo_id"], "trajectory_id").select("repo_id", "trajectory_id"))
query("src29_latest_eval_run", "SRC-29", "runs", "SELECT workflow, max_by(run_id, struct_pack(a := start_ts, b := run_id)) AS run_id FROM runs WHERE status = 'completed' GROUP BY workflow")(lambda r: r.where("status = 'completed'").groupBy("workflow").agg(F.max_by("run_id", F.struct("start_ts", "run_id")).alias("run_id")))
query("top06_ledger", "TOP-06", "runs", "SELECT run_id, start_ts FROM runs WHERE workflow = '1-URGENT' AND repo_id = 'repo:4' ORDER BY start_ts DESC, run_id LIMIT 30")(lambda r: st.newest(r, "start_ts", "run_id", 30, workflow="1-URGENT", repo_id="repo:4").select("run_id", "start_ts"))
query("top07_readiness_history", "TOP-07", "runs", "SELECT repo_id, start_ts, CAST(floor(cost) AS BIGINT) % 100 AS score FROM runs WHERE repo_id = 'repo:6' ORDER BY start_ts DESC, run_id LIMIT 20")(lambda r: st.newest(r, "start_ts", "run_id", 20, repo_id="repo:6").select("repo_id", "start_ts", (F.floor("cost").cast("long") % 100).alias("score")))
query("top08_snapshots", "TOP-08", "runs", "SELECT parent_id, status, start_ts FROM runs WHERE status = 'completed' ORDER BY start_ts DESC, run_id LIMIT 15")(lambda r: st.newest(r, "start_ts", "run_id", 15, status="completed").select("parent_id", "status", "start_ts"))
query("top09_sarif_runs", "TOP-09", "runs", "SELECT run_id FROM runs WHERE repo_id = 'repo:2' AND workflow = '5-LOW' ORDER BY start_ts DESC, run_id")(lambda r: st.newest(r, "start_ts", "run_id", None, repo_id="repo:2", workflow="5-LOW").select("run_id"))

# --- memory -------------------------------------------------------------------------------------

query("rnk25_write_gates", "RNK-25", "memories", """WITH f AS (SELECT trajectory_id, graph_snapshot_id, CASE WHEN NOT opted_in THEN 'opt_in_check' WHEN coalesce(source_run_id, '') = '' OR coalesce(repo_id, '') = '' THEN 'required_fields' WHEN retention_class NOT IN ('ephemeral','workspace_local','long_term','archived') THEN 'data_classification' WHEN regexp_matches(payload, '(?:password|secret|token|api_key|credential)\\s*[:=]\\s*\\S+', 'i') THEN 'secret_scan' WHEN snippet IN ('raw_prompt','full_trace','full_source','command_output') THEN 'snippet_type_check' END AS failed FROM memories)
SELECT trajectory_id, failed, failed IS NULL AS written, failed IS NULL AND graph_snapshot_id IS NULL AS contradiction FROM f""")(lambda m: me.write_gates(m.withColumn("snippets", F.array("snippet"))))
_HINT = """h AS (SELECT trajectory_id, utility, list_distinct(list_filter(string_split_regex(lower(payload), '\\s+'), lambda w: w <> '')) AS own, score % 11 = 0 AS expired, CASE WHEN score % 5 = 0 THEN 'unreviewed' WHEN score % 7 = 0 THEN 'superseded' ELSE 'reviewed' END AS rs, coalesce(repo_id, '-') AS issue_id FROM memories),
s AS (SELECT *, CASE WHEN len(own) > 0 THEN CAST(len(list_intersect(own, ['the','and','of','thion','thand'])) AS DOUBLE) / len(own) ELSE 0 END AS sim FROM h), q AS (SELECT *, CASE WHEN expired THEN 'expired' WHEN rs <> 'reviewed' THEN rs WHEN sim >= 0.85 AND utility = 'low' THEN 'high_similarity_low_utility' END AS reason FROM s)"""


def _hint(m, by_similarity):
    r = m.withColumn("issue_id", F.coalesce("repo_id", F.lit("-"))).withColumn("expired", F.col("score") % 11 == 0).withColumn("review_state", F.when(F.col("score") % 5 == 0, "unreviewed").when(F.col("score") % 7 == 0, "superseded").otherwise("reviewed"))
    words = F.array(*map(F.lit, ("the", "and", "of", "thion", "thand")))
    return me.hints(r, words, "payload", by_similarity).withColumn("similarity", F.round("similarity", 6)).select("issue_id", "trajectory_id", "similarity", "reason", "place")


for _name, _row, _by in (("top12_fine_hints", "TOP-12 RNK-20", True), ("top11_coarse_hints", "TOP-11", False)):
    _order = "sim DESC" if _by else "CASE WHEN utility = 'high' THEN 0 ELSE 1 END"
    query(_name, _row, "memories", f"WITH {_HINT} SELECT issue_id, trajectory_id, round(sim, 6) AS similarity, reason, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY issue_id, reason IS NULL ORDER BY {_order}, trajectory_id) <= 5 THEN row_number() OVER (PARTITION BY issue_id, reason IS NULL ORDER BY {_order}, trajectory_id) END AS place FROM q")(lambda m, by=_by: _hint(m, by))
query("rnk21_utility", "RNK-21", "memories", "SELECT trajectory_id, round(greatest(0, least(1, CASE utility WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.1 ELSE 0.3 END::DOUBLE + CASE WHEN score % 3 = 0 THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN score % 4 = 0 THEN 0.2 ELSE 0 END::DOUBLE)), 6) AS score FROM memories")(lambda m: m.select("trajectory_id", F.round(rk.utility_score(F.col("utility"), F.when(F.col("score") % 3 == 0, "resolved").otherwise("open"), F.col("score") % 4 == 0), 6).alias("score")))
query("rnk22_relabelled", "RNK-22", "memories", "SELECT concat('relabelled:', substr(md5(concat(trajectory_id, '|', utility)), 1, 8)) AS trajectory_id, trajectory_id AS source_id, CASE WHEN snippet = 'full_trace' THEN 'resolved' ELSE snippet END AS outcome, 'medium' AS utility, 'unreviewed' AS review_state, utility AS goal FROM memories")(lambda m: me.relabelled(m.select("trajectory_id", F.when(F.col("snippet") == "full_trace", "no_fix_found").otherwise(F.col("snippet")).alias("outcome"), "utility"), F.col("utility")))

# --- reviews ------------------------------------------------------------------------------------

_RUN = """e AS (SELECT concat('run:', l_orderkey % 400) AS run_id, CASE l_linenumber WHEN 1 THEN 'tool_call' WHEN 2 THEN 'gate_result' WHEN 3 THEN 'budget_event' WHEN 4 THEN 'final_verdict' WHEN 5 THEN 'budget_hard_stop' WHEN 6 THEN 'verification_event' ELSE CASE WHEN l_suppkey % 3 = 0 THEN 'policy_violation' ELSE 'readiness_failure' END END AS type, CASE WHEN l_returnflag = 'R' THEN concat('act', l_partkey % 9) END AS action, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'deny' WHEN l_returnflag = 'R' THEN 'approve' ELSE 'none' END AS policy_action, concat(CASE WHEN l_partkey % 31 = 0 THEN 'etc/' ELSE 'src/' END, l_partkey % 97, '.py') AS file, l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0)"""


def _run_events(li):
    n, r = F.col("l_linenumber"), F.col("l_returnflag")
    kind = F.when(n == 1, "tool_call").when(n == 2, "gate_result").when(n == 3, "budget_event").when(n == 4, "final_verdict").when(n == 5, "budget_hard_stop").when(n == 6, "verification_event").when(F.col("l_suppkey") % 3 == 0, "policy_violation").otherwise("readiness_failure")
    return li.where("l_orderkey % 3 = 0").select(
        F.concat(F.lit("run:"), (F.col("l_orderkey") % 400).cast("string")).alias("run_id"),
        kind.alias("type"),
        F.when(r == "R", F.concat(F.lit("act"), (F.col("l_partkey") % 9).cast("string"))).alias("action"),
        F.when((F.col("l_linestatus") == "O") & (r == "A"), "deny").when(r == "R", "approve").otherwise("none").alias("policy_action"),
        F.concat(F.when(F.col("l_partkey") % 31 == 0, "etc/").otherwise("src/"), (F.col("l_partkey") % 97).cast("string"), F.lit(".py")).alias("file"),
        "l_orderkey",
    )


def _audited(li):
    runs = _run_events(li).groupBy("run_id").agg(F.collect_set("file").alias("changed"), F.collect_set(F.when(F.col("l_orderkey") % 5 > 0, F.col("type"))).alias("events"))
    return rv.scope_audit(runs)


_SCOPE = f"""WITH {_RUN}, g AS (SELECT run_id, list(DISTINCT file) FILTER (NOT file LIKE 'src/%') AS outs, list(DISTINCT type) FILTER (l_orderkey % 5 > 0) AS ev FROM e GROUP BY run_id),
h AS (SELECT run_id, coalesce(array_to_string(list_sort(outs), ','), '') AS out_of_scope, CASE WHEN ev IS NULL THEN ['tool_call','gate_result','budget_event','final_verdict'] ELSE ev END AS seen FROM g),
x AS (SELECT run_id, out_of_scope, array_to_string(list_filter(['budget_event','final_verdict','gate_result','tool_call'], lambda t: NOT list_contains(seen, t)), ',') AS missing, list_contains(seen, 'budget_hard_stop') AS stop FROM h),
y AS (SELECT run_id, out_of_scope, missing, CASE WHEN out_of_scope <> '' THEN 'process-noncompliant' WHEN stop THEN 'budget-exhausted' WHEN missing <> '' THEN 'trace-incomplete' ELSE 'process-compliant' END AS verdict FROM x)"""
query("flt13_scope_audit", "FLT-13 SET-02", "lineitem", f"{_SCOPE} SELECT * FROM y")(lambda li: _audited(li).select("run_id", _joined("out_of_scope"), _joined("missing"), "verdict"))
query("fun33_operational_recommendation", "FUN-33", "lineitem", f"{_SCOPE} SELECT run_id, CASE verdict WHEN 'process-compliant' THEN 'merge-supporting' WHEN 'process-noncompliant' THEN 'block' ELSE 'review-required' END AS recommendation FROM y")(lambda li: _audited(li).select("run_id", rv.operational_recommendation(F.col("verdict")).alias("recommendation")))
query("fun12_merge_recommendation", "FUN-12", "lineitem", f"{_SCOPE}, z AS (SELECT run_id, CASE verdict WHEN 'process-compliant' THEN 'merge-supporting' WHEN 'process-noncompliant' THEN 'block' ELSE 'review-required' END AS op, CASE CAST(substr(run_id, 5) AS INT) % 4 WHEN 0 THEN 'merge-supporting' WHEN 1 THEN 'block' WHEN 2 THEN 'unknown' ELSE 'review-required' END AS risk FROM y) SELECT run_id, CASE WHEN op = 'block' OR risk = 'block' THEN 'block' WHEN op = 'merge-supporting' AND risk = 'merge-supporting' THEN 'merge-supporting' WHEN risk = 'unknown' THEN 'unknown' ELSE 'review-required' END AS merge FROM z")(lambda li: _audited(li).select("run_id", rv.merge_of(F.element_at(F.array(*map(F.lit, ("merge-supporting", "block", "unknown", "review-required"))), (F.substring("run_id", 5, 9).cast("int") % 4 + 1)), rv.operational_recommendation(F.col("verdict"))).alias("merge")))
query("agg40_operational_review", "AGG-40", "lineitem", f"""WITH {_RUN}, g AS (SELECT run_id, list(DISTINCT type) AS t, coalesce(array_to_string(list_sort(list(coalesce(action, type)) FILTER (policy_action = 'deny')), ','), '') AS denied, coalesce(array_to_string(list_sort(list(coalesce(action, type)) FILTER (policy_action = 'approve')), ','), '') AS approved FROM e GROUP BY run_id),
c AS (SELECT *, list_has_all(t, ['tool_call','gate_result','budget_event','final_verdict']) AS complete FROM g)
SELECT run_id, CASE WHEN NOT complete THEN 'trace-incomplete' WHEN list_contains(t, 'budget_hard_stop') THEN 'budget-exhausted' WHEN list_contains(t, 'policy_violation') THEN 'process-noncompliant' WHEN list_contains(t, 'readiness_failure') THEN 'needs-readiness-work' ELSE 'process-compliant' END AS verdict, CASE WHEN complete THEN 'complete' ELSE 'missing' END AS trace, CASE WHEN list_contains(t, 'budget_hard_stop') THEN 'hard-stop' ELSE 'within-budget' END AS budget, CASE WHEN list_contains(t, 'verification_event') THEN 'adequate' ELSE 'not_recorded' END AS verification, denied, approved FROM c""")(lambda li: rv.operational_review(_run_events(li)).withColumn("denied", F.array_join("denied", ",")).withColumn("approved", F.array_join("approved", ",")))
query("flt21_dynamic_verdicts", "FLT-21", "orders", "SELECT o_orderkey AS clause_id, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 9 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 0 THEN 'violated' WHEN o_orderkey % 5 <> 0 THEN 'satisfied' ELSE 'unknown' END AS verdict, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 9 = 0 THEN 'unknown' ELSE 'heuristic' END AS confidence FROM orders")(lambda o: o.select(F.col("o_orderkey").alias("clause_id"), rv.dynamic_verdict(F.when(F.col("o_orderstatus") == "P", "not_implemented").otherwise("done"), F.col("o_orderkey") % 9 > 0, (F.col("o_orderkey") % 4 == 0).cast("int"), (F.col("o_orderkey") % 5)).alias("v")).select("clause_id", "v.*"))
query("flt22_operational_evidence", "FLT-22", "orders customer", "SELECT c_custkey AS clause_id, o_orderkey AS run_id, concat('graph://snapshot/', CASE WHEN o_orderkey % 3 = 0 OR o_orderkey IS NULL THEN 'unknown' ELSE concat('s', o_orderkey % 3) END) AS resource, o_orderkey IS NULL OR o_orderkey % 3 = 0 AS stale FROM customer LEFT JOIN orders ON o_custkey = c_custkey")(lambda o, c: rv.operational_evidence(c.select(F.col("c_custkey").alias("clause_id")), o.select(F.col("o_custkey").alias("clause_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string"))).alias("snapshot_id"))))
query("fun16_static_verdicts", "FUN-16", "part", """WITH c AS (SELECT p_partkey AS clause_id, p_size % 10 = 0 AS policy, p_partkey % 3 = 0 AS gate_missing, p_size % 7 = 0 AS fired, CASE p_partkey % 7 WHEN 0 THEN 'ungrounded' WHEN 1 THEN 'service_spec' WHEN 2 THEN 'policy_principle' WHEN 3 THEN 'scope_definition' WHEN 4 THEN 'structured_record' ELSE 'symbol' END AS g, CASE p_size % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'not_applicable' END AS k FROM part), v AS (SELECT *, CASE WHEN policy THEN CASE WHEN gate_missing THEN 'violated' ELSE 'satisfied' END WHEN fired THEN 'violated' WHEN g = 'ungrounded' THEN 'unknown' WHEN g <> 'symbol' OR k <> 'failed' THEN 'satisfied' ELSE 'unknown' END AS verdict FROM c)
SELECT clause_id, verdict, CASE WHEN policy THEN CASE WHEN gate_missing THEN 'gate_missing' ELSE 'gate_present' END WHEN fired THEN 'predicate_fired' WHEN g = 'ungrounded' THEN 'missing_grounding' WHEN g <> 'symbol' THEN g WHEN k <> 'failed' THEN 'graph_path' ELSE 'not_compiled' END AS evidence, CASE WHEN policy OR fired THEN 'analyser' WHEN verdict = 'satisfied' THEN 'heuristic' ELSE 'unknown' END AS confidence FROM v""")(lambda p: p.select(F.col("p_partkey").alias("clause_id"), rv.static_verdict(F.col("p_size") % 10 == 0, F.col("p_partkey") % 3 == 0, F.col("p_size") % 7 == 0, F.element_at(F.array(*map(F.lit, ("ungrounded", "service_spec", "policy_principle", "scope_definition", "structured_record", "symbol", "symbol"))), (F.col("p_partkey") % 7 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("passed", "failed", "not_applicable"))), F.col("p_size") % 3 + 1)).alias("v")).select("clause_id", "v.*"))
query("agg28_test_delta", "AGG-28", "lineitem", "WITH g AS (SELECT l_orderkey AS diff_id, list(DISTINCT l_suppkey) FILTER (l_linenumber % 2 = 0) AS bf, list(DISTINCT l_suppkey) FILTER (l_linenumber % 3 = 0) AS af, list(DISTINCT l_suppkey) AS bp FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1) SELECT diff_id, len(bp) AS tests_run, coalesce(array_to_string(list_sort(list_filter(af, lambda x: NOT list_contains(coalesce(bf, []), x))), ','), '') AS newly_failing, coalesce(array_to_string(list_sort(list_filter(bf, lambda x: NOT list_contains(coalesce(af, []), x))), ','), '') AS newly_passing FROM g")(lambda li: rv.tests_changed(li.where("l_orderkey % 4 = 0").groupBy(F.col("l_orderkey").alias("diff_id")).agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey"))).alias("before_failed"), F.collect_set(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey"))).alias("after_failed"), F.collect_set("l_suppkey").alias("before_passed"), F.collect_set(F.lit(None).cast("long")).alias("after_passed"))).select("diff_id", "tests_run", F.array_join(F.col("newly_failing").cast("array<string>"), ",").alias("newly_failing"), F.array_join(F.col("newly_passing").cast("array<string>"), ",").alias("newly_passing")))
query("set03_dryrun_mismatches", "SET-03", "lineitem", "WITH p AS (SELECT DISTINCT l_orderkey AS diff_id, concat('f', l_partkey % 50) AS file FROM lineitem WHERE l_linenumber <= 3), a AS (SELECT DISTINCT l_orderkey AS diff_id, concat('f', l_partkey % 50) AS file FROM lineitem WHERE l_linenumber >= 2), x AS (SELECT a.*, 'extra_files_changed' AS mismatch, 'medium' AS severity FROM a WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.diff_id = a.diff_id AND p.file = a.file) AND diff_id IN (SELECT diff_id FROM p) UNION ALL SELECT p.*, 'fewer_files_changed', 'low' FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE p.diff_id = a.diff_id AND p.file = a.file)) SELECT diff_id, mismatch, severity, string_agg(file, ',' ORDER BY file) AS files FROM x GROUP BY ALL")(lambda li: rv.dryrun_mismatches(_files(li.where("l_linenumber <= 3")), _files(li.where("l_linenumber >= 2"))).withColumn("files", F.array_join("files", ",")))


def _files(li):
    return li.select(F.col("l_orderkey").alias("diff_id"), F.concat(F.lit("f"), (F.col("l_partkey") % 50).cast("string")).alias("file")).distinct()


query("jon19_sheet_changes", "JON-19", "part", "WITH s AS (SELECT p_partkey AS sheet_id, unnest(['p_brand', 'p_size', 'p_type']) AS field, unnest([p_brand, CAST(p_size AS VARCHAR), p_type]) AS before, unnest([CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END, CAST(p_size + p_partkey % 2 AS VARCHAR), p_type]) AS after FROM part) SELECT * FROM s WHERE before IS DISTINCT FROM after")(lambda p: rv.sheet_changes(p.withColumnRenamed("p_partkey", "sheet_id"), p.withColumn("p_size", F.col("p_size") + F.col("p_partkey") % 2).withColumn("p_brand", F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand"))).withColumnRenamed("p_partkey", "sheet_id"), ["p_brand", "p_size", "p_type"]))
query("jon15_manifest_regressions", "JON-15", "part", "WITH a AS (SELECT concat(CASE p_partkey % 6 WHEN 0 THEN 'Prompt/' WHEN 1 THEN 'AGENTS/' WHEN 2 THEN 'tool/' WHEN 3 THEN 'skill/' WHEN 4 THEN 'policy/' ELSE 'spec/' END, p_partkey) AS artefact_id, p_partkey, p_size FROM part) SELECT artefact_id, CASE p_partkey % 6 WHEN 0 THEN 'visible_behaviour' WHEN 1 THEN 'policy_relevant' WHEN 2 THEN 'tool_order' WHEN 3 THEN 'hidden_policy' WHEN 4 THEN 'policy_relevant' ELSE 'spec_evolution' END AS classification, p_partkey % 6 IN (1, 4) AS blocks FROM a WHERE p_partkey % 5 > 0 AND p_size % 3 > 0")(lambda p: rv.manifest_regressions(*_manifests(p)))


def _manifests(p):
    a = p.select(F.concat(F.element_at(F.array(*map(F.lit, ("Prompt/", "AGENTS/", "tool/", "skill/", "policy/", "spec/"))), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_partkey").cast("string")).alias("artefact_id"), F.col("p_brand").alias("digest"), "p_size", "p_partkey")
    return a.where("p_partkey % 5 > 0").select("artefact_id", "digest"), a.select("artefact_id", F.when(F.col("p_size") % 3 > 0, F.concat("digest", F.lit("x"))).otherwise(F.col("digest")).alias("digest"))


_DIFF = "d AS (SELECT doc_id AS diff_id, CASE doc_id % 4 WHEN 0 THEN ['src/api/x.py','src/y.py'] WHEN 1 THEN ['openapi.yaml'] ELSE ['src/z.py'] END AS files, CASE WHEN doc_id % 3 = 0 THEN concat('def f(a): ', substr(text, 1, 30)) ELSE substr(text, 1, 30) END AS removed, CASE WHEN doc_id % 2 = 0 THEN concat('def f(a, b): ', substr(text, 1, 30)) WHEN doc_id % 5 = 0 THEN 'x is required' ELSE substr(text, 1, 30) END AS added FROM documents)"
query("fun09_interface_compatibility", "FUN-09", "documents", f"WITH {_DIFF}, x AS (SELECT *, contains(removed, 'def ') AND contains(added, 'def ') AND removed <> added AS s, contains(added, 'required') AS r, doc_id_api AS n FROM (SELECT *, diff_id % 4 IN (0, 1) AS doc_id_api FROM d)) SELECT diff_id, CASE WHEN n THEN 'http-rest' ELSE 'unknown' END AS interface_type, concat_ws(',', CASE WHEN s THEN 'interface signature changed' END, CASE WHEN r THEN 'required parameter added' END) AS breaking, CASE WHEN n AND NOT s AND NOT r THEN 'interface file changed' ELSE '' END AS candidates FROM x")(lambda d: rv.interface_compatibility(_diffs(d)).select("diff_id", "interface_type", _joined("breaking"), _joined("candidates")))


def _diffs(d):
    k, t = F.col("doc_id"), F.substring("text", 1, 30)
    strings = lambda *x: F.array(*map(F.lit, x))
    return d.select(k.alias("diff_id"), F.when(k % 4 == 0, strings("src/api/x.py", "src/y.py")).when(k % 4 == 1, strings("openapi.yaml")).otherwise(strings("src/z.py")).alias("files"), F.when(k % 3 == 0, F.concat(F.lit("def f(a): "), t)).otherwise(t).alias("removed"), F.when(k % 2 == 0, F.concat(F.lit("def f(a, b): "), t)).when(k % 5 == 0, "x is required").otherwise(t).alias("added"))


query("agg39_regression_verdicts", "AGG-39", "orders", "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 = 0 THEN 'inconclusive' ELSE 'equal' END AS verdict, o_orderkey % 60 > 30 AS stale FROM orders")(lambda o: o.select(F.col("o_orderkey").alias("run_id"), rv.regression_verdict(F.when(F.col("o_orderkey") % 4 > 0, "b"), F.col("o_orderkey") % 60).alias("v")).select("run_id", "v.*"))
query("fun25_permissions", "FUN-25 FLT-24", "orders nation", """WITH a AS (SELECT o_orderkey AS ask_id, concat('r', o_custkey % 40) AS repo_id, concat('w', o_orderkey % 30) AS workflow, CASE o_orderkey % 6 WHEN 0 THEN 'read' WHEN 1 THEN 'search' WHEN 2 THEN 'edit' WHEN 3 THEN 'execute' WHEN 4 THEN 'review' ELSE 'commit' END AS capability FROM orders),
v AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'workflow' ELSE 'repo' END AS kind, concat(CASE WHEN n_nationkey % 2 = 0 THEN 'w' ELSE 'r' END, n_nationkey) AS name, CASE n_regionkey WHEN 0 THEN 'read_search' WHEN 1 THEN 'read_search_edit' WHEN 2 THEN 'read_search_execute' WHEN 3 THEN 'review' ELSE 'commit' END AS mode FROM nation),
j AS (SELECT ask_id, capability, coalesce(w.mode, r.mode, 'read_only') AS mode FROM a LEFT JOIN v w ON w.kind = 'workflow' AND w.name = workflow LEFT JOIN v r ON r.kind = 'repo' AND r.name = repo_id)
SELECT ask_id, mode, CASE mode WHEN 'read_only' THEN capability = 'read' WHEN 'read_search' THEN capability IN ('read','search') WHEN 'read_search_edit' THEN capability IN ('read','search','edit') WHEN 'read_search_execute' THEN capability IN ('read','search','execute') WHEN 'review' THEN capability IN ('read','search','review') ELSE true END AS allowed, mode <> 'read_only' AS widened FROM j""")(lambda o, n: rv.permissions(o.select(F.col("o_orderkey").alias("ask_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("repo_id"), F.concat(F.lit("w"), (F.col("o_orderkey") % 30).cast("string")).alias("workflow"), F.element_at(F.array(*map(F.lit, ("read", "search", "edit", "execute", "review", "commit"))), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("capability")), n.select(F.when(F.col("n_nationkey") % 2 == 0, "workflow").otherwise("repo").alias("kind"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "w").otherwise("r"), F.col("n_nationkey").cast("string")).alias("name"), F.element_at(F.array(*map(F.lit, ("read_search", "read_search_edit", "read_search_execute", "review", "commit"))), F.col("n_regionkey") + 1).alias("mode"))))
_ADV = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rv.OUTCOMES.items())
query("fun27_adversarial_checks", "FUN-27", "events", f"WITH f AS (SELECT concat('adv:', event_id) AS id, CASE event_id % 7 WHEN 0 THEN 'prompt_injection' WHEN 1 THEN 'document_injection' WHEN 2 THEN 'tool_boundary_misuse' WHEN 3 THEN 'out_of_scope_write' WHEN 4 THEN 'multistep_policy_bypass' WHEN 5 THEN 'reward_hackable_task' ELSE 'other' END AS t, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'blocked' ELSE 'typed_error' END AS x FROM events), g AS (SELECT *, coalesce(CASE t {_ADV} END, 'unknown') AS actual FROM f) SELECT concat('check:', id) AS check_id, actual, actual = coalesce(x, actual) AS passed FROM g")(lambda e: rv.adversarial_checks(e.select(F.concat(F.lit("adv:"), F.col("event_id").cast("string")).alias("fixture_id"), F.element_at(F.array(*map(F.lit, (*rv.OUTCOMES, "other"))), (F.col("event_id") % 7 + 1).cast("int")).alias("check_type"), F.when(F.col("event_id") % 5 == 1, "blocked").when(F.col("event_id") % 5 > 1, "typed_error").alias("expected"))))
query("fun26_canaries", "FUN-26", "orders", "SELECT concat('canary:', o_orderkey) AS canary_id, o_orderpriority AS model_id, o_custkey AS probe_id, 'unknown' AS verdict FROM orders")(lambda o: rv.canaries(o.select(F.col("o_orderkey").alias("eval_run_id"), F.col("o_orderpriority").alias("model_id"), F.col("o_custkey").alias("probe_id"))))
query("str14_monitor_hooks", "STR-14 STR-08 FUN-19", "orders", "WITH s AS (SELECT o_orderkey AS run_id, CAST(o_totalprice AS BIGINT) AS used, o_orderkey % 7 AS loops, o_orderkey % 3 AS snap FROM orders) SELECT run_id, 'token_budget_hard_stop' AS monitor, 'error' AS severity, 'budget_exhausted' AS status FROM s WHERE used >= 200000 UNION ALL SELECT run_id, 'doom_loop_candidate', 'error', 'failed' FROM s WHERE loops >= 5 UNION ALL SELECT run_id, 'stale_snapshot', 'warning', NULL FROM s WHERE snap <> 1")(lambda o: rv.monitor_events(o.select(F.col("o_orderkey").alias("run_id"), F.round("o_totalprice").cast("long").alias("tokens_used"), F.lit(200_000).alias("token_budget"), (F.col("o_orderkey") % 7).alias("loops"), F.lit(5).alias("max_loops"), (F.col("o_orderkey") % 3).alias("snapshot_id"), F.lit(1).alias("current_snapshot_id"))))
query("agg27_delete_audit", "AGG-27", "events", f"SELECT event_type AS record_type, count(*) AS n FROM events WHERE (event_type = 'click' AND ts < {AS_OF.replace('timestamp', 'TIMESTAMP ')} - INTERVAL 5 DAY) OR (event_type = 'error' AND ts < {AS_OF.replace('timestamp', 'TIMESTAMP ')} - INTERVAL 10 DAY) GROUP BY 1")(lambda e: _deleted(e))


def _deleted(e):
    aged = retained(e, "event_type", "ts", F.expr(AS_OF), {"click": 5, "error": 10, "view": -1})
    return aged.where("expired").groupBy(F.col("event_type").alias("record_type")).agg(F.count("*").alias("n"))


# --- answers ------------------------------------------------------------------------------------

_Q = """q AS (SELECT c_custkey AS question_id, CASE WHEN c_custkey % 3 = 0 THEN 'geo' ELSE 'crm' END AS repo_id, CASE c_custkey % 5 WHEN 0 THEN concat('Where is the file `c', c_custkey % 40, '.py`') WHEN 1 THEN concat('How does `', c_name, '` flow over http') WHEN 2 THEN 'How does it happen' WHEN 3 THEN concat('Which alert or warning hits `', lower(replace(c_name, '#', '')), '`') ELSE 'Where is `n2.py` and `geo/n3.py`' END AS text FROM customer),
i AS (SELECT question_id, repo_id, CASE question_id % 5 WHEN 0 THEN 'file_location' WHEN 1 THEN 'behaviour_trace' WHEN 2 THEN 'behaviour_trace' WHEN 3 THEN 'static_analysis' ELSE 'file_location' END AS class, list_distinct(regexp_extract_all(text, '`([^`]+)`', 1)) AS tokens, regexp_extract_all(text, '`([^`]+)`', 1) AS raw, contains(lower(text), 'http') AS cross_language FROM q),
t AS (SELECT question_id, repo_id, class, unnest(tokens) AS token FROM i),
x1 AS (SELECT question_id, node_id, 'parser' AS confidence FROM t JOIN nodes n ON n.repo_id = t.repo_id AND n.file_path LIKE '%' || token WHERE class = 'file_location' AND string_split(n.file_path, '/')[-1] = string_split(token, '/')[-1] UNION SELECT question_id, node_id, 'parser' FROM t JOIN nodes n ON n.repo_id = t.repo_id AND (n.label = token OR n.qualified_name = token) WHERE class <> 'file_location'),
x2 AS (SELECT DISTINCT question_id, node_id, 'heuristic' AS confidence FROM t JOIN nodes n ON n.repo_id = t.repo_id AND regexp_replace(lower(n.label), '[^a-z0-9]', '', 'g') = regexp_replace(lower(token), '[^a-z0-9]', '', 'g') WHERE class <> 'file_location' AND question_id NOT IN (SELECT question_id FROM x1)),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE confidence WHEN 'parser' THEN 0 ELSE 1 END, node_id) AS k FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x2)),
g AS (SELECT question_id, count(*) AS n, bool_or(confidence = 'parser') AS sure, string_agg(node_id, ',' ORDER BY node_id) AS nodes, min_by(node_id, k) AS first FROM f WHERE k <= 20 GROUP BY 1)"""


def _questions(c):
    k, name = F.col("c_custkey"), F.col("c_name")
    m = k % 5
    text = F.when(m == 0, F.concat(F.lit("Where is the file `c"), (k % 40).cast("string"), F.lit(".py`"))).when(m == 1, F.concat(F.lit("How does `"), name, F.lit("` flow over http"))).when(m == 2, "How does it happen").when(m == 3, F.concat(F.lit("Which alert or warning hits `"), F.lower(F.replace(name, F.lit("#"), F.lit(""))), F.lit("`"))).otherwise("Where is `n2.py` and `geo/n3.py`")
    return c.select(k.alias("question_id"), F.when(k % 3 == 0, "geo").otherwise("crm").alias("repo_id"), text.alias("text"))


query("rnk17_answers", "RNK-17 RNK-16", "customer nodes", f"WITH {_Q}, a AS (SELECT i.question_id, class, coalesce(n, 0) AS n_evidence, coalesce(nodes, '') AS nodes, CASE WHEN n IS NULL OR (class = 'behaviour_trace' AND len(raw) = 0) THEN 'unknown' WHEN class = 'file_location' THEN CASE WHEN sure THEN 'parser' ELSE 'heuristic' END ELSE 'heuristic' END AS confidence FROM i LEFT JOIN g ON i.question_id = g.question_id) SELECT *, CASE WHEN confidence = 'unknown' THEN CASE class WHEN 'behaviour_trace' THEN 'name a start symbol' WHEN 'file_location' THEN 'name a file' ELSE 'name a symbol' END END AS action FROM a")(lambda c, n: an.answers(_questions(c), n).withColumn("nodes", F.array_join("nodes", ",")))
query("grf15_behaviour_traces", "GRF-15", "customer nodes", f"WITH {_Q} SELECT i.question_id, CASE WHEN len(raw) > 0 THEN first END AS path, CASE WHEN len(raw) > 0 AND first IS NOT NULL THEN 'heuristic' ELSE 'unknown' END AS confidence, CASE WHEN len(raw) = 0 THEN 'NO_START_SYMBOL' WHEN first IS NULL THEN 'NO_START_NODE' END AS diagnostic FROM i LEFT JOIN g ON i.question_id = g.question_id WHERE class = 'behaviour_trace'")(lambda c, n: _traced(_questions(c), n))


def _traced(q, n):
    asked = an.intents(q)
    return an.traces(asked, an.evidence(asked, n)).withColumn("path", F.array_join("path", ","))


query("rnk18_contracts", "RNK-18", "orders", "SELECT concat('i', o_orderkey) AS interface_id, o_orderpriority AS plugin_id, op AS operation FROM (SELECT *, unnest([concat('GET /c/', o_custkey % 9), concat('Post /o/', o_orderkey % 9)]) AS op FROM orders) WHERE o_orderpriority = '2-HIGH' AND contains(lower(op), 'post /o/3')")(lambda o: an.contracts(o.select(F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("interface_id"), F.col("o_orderpriority").alias("plugin_id"), F.array(F.concat(F.lit("GET /c/"), (F.col("o_custkey") % 9).cast("string")), F.concat(F.lit("Post /o/"), (F.col("o_orderkey") % 9).cast("string"))).alias("operations")), "POST /o/3", "2-HIGH"))
query("rnk11_uncertainty", "RNK-11", "orders", "WITH u AS (SELECT o_orderkey AS id, o_orderkey % 10 / 10.0 < 0.3 AS low, o_orderkey % 3 > 0 AS emb, o_orderkey % 4 = 0 AS stale, o_orderkey % 20 > 10 AS over, o_orderkey % 7 = 0 AS unres FROM orders) SELECT id, CASE WHEN low OR stale OR unres THEN 'heuristic' END AS cap, concat_ws(',', CASE WHEN low THEN 'low agreement' END, CASE WHEN NOT emb THEN 'no embedding' END, CASE WHEN stale THEN 'stale graph' END, CASE WHEN over THEN 'over budget' END, CASE WHEN unres THEN 'frames unresolved' END) AS notes FROM u")(lambda o: o.select(F.col("o_orderkey").alias("id"), an.uncertainty(F.col("o_orderkey") % 10 / 10, F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 20, F.col("o_orderkey") % 7 == 0).alias("u")).select("id", "u.cap", F.array_join("u.notes", ",").alias("notes")))
_W = "CASE signal_type WHEN 'keyword' THEN 0.25 WHEN 'sarif' THEN 0.2 WHEN 'blame' THEN 0.15 WHEN 'graph_neighbour' THEN 0.1 END::DOUBLE"
_MERGED = f"""w AS (SELECT *, {_W} AS w FROM signals), t AS (SELECT repo_id, file_path, signal_type, sum(raw_score * w) AS s, any_value(w) AS w, max(raw_score) AS best, bool_or(is_generated) AS g FROM w GROUP BY ALL),
x AS (SELECT repo_id, file_path, bool_or(g) AS is_generated, count(*) AS types, round(least(sum(s) / sum(w), 1.0), 9) AS score, string_agg(concat(signal_type, '=', printf('%.3f', best)), '; ' ORDER BY w DESC, signal_type) AS chain FROM t GROUP BY repo_id, file_path), r AS (SELECT *, row_number() OVER (ORDER BY is_generated, types DESC, score DESC, repo_id, file_path) AS place FROM x WHERE score >= 0.05)"""
query("rnk12_investigations", "RNK-12", "signals", f"WITH {_MERGED} SELECT repo_id, file_path, place, chain FROM r WHERE place <= 8")(lambda s: an.investigate(s))
query("rnk10_context", "RNK-10", "signals nodes", f"WITH {_MERGED}, p AS (SELECT r.repo_id, r.file_path, r.place, n.node_id, row_number() OVER (PARTITION BY r.repo_id, r.file_path ORDER BY n.start_line, n.node_id) AS k FROM r JOIN nodes n ON r.repo_id = n.repo_id AND r.file_path = n.file_path WHERE place <= 15), c AS (SELECT repo_id, file_path, string_agg(node_id, ',' ORDER BY node_id) AS symbols FROM p WHERE k <= 5 GROUP BY ALL) SELECT r.repo_id, r.file_path, place, coalesce(symbols, '') AS symbols, place > 10 AS beyond FROM r LEFT JOIN c ON r.repo_id = c.repo_id AND r.file_path = c.file_path WHERE place <= 15")(lambda s, n: an.context(an.investigate(s, 15), n).withColumn("symbols", F.array_join("symbols", ",")))
_SUSPECTS = ("customers of FRANCE and geo in building", ["src/geo/n1.py"], ["geo.FRANCE"])
query("rnk09_localise", "RNK-09", "nodes edges", f"""WITH {keyword_sql(*_SUSPECTS)}, c AS (SELECT repo_id, file_path, score FROM kw), {EXPAND}, sg AS (SELECT repo_id, file_path, 'keyword' AS t, score AS raw, 0.25::DOUBLE AS w FROM kw UNION ALL SELECT repo_id, file_path, 'graph_neighbour', score, 0.1::DOUBLE FROM ex),
x AS (SELECT repo_id, file_path, false AS is_generated, count(*) AS types, least(sum(raw * w) / sum(w), 1.0) AS score, count(*) FILTER (raw > 0.3)::DOUBLE / count(*) AS agreement FROM sg GROUP BY ALL)
SELECT repo_id, file_path, is_generated, types, round(score, 6) AS score, round(agreement, 6) AS agreement, CASE WHEN agreement >= 0.6 THEN 'analyser' ELSE 'heuristic' END AS confidence FROM x WHERE score >= 0.05 ORDER BY types DESC, round(score, 9) DESC, repo_id, file_path LIMIT 8""")(lambda n, e: an.localise(n, e, *_SUSPECTS).withColumn("score", F.round("score", 6)).withColumn("agreement", F.round("agreement", 6)))

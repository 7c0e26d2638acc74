"""Queries over contracts in source text and over files that are written and read back, each with its DuckDB oracle."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from lodestone.operators import contracts as ct
from lodestone.operators import indexers as ix
from lodestone.operators import sarif as sa
from lodestone.plans.registry import query
from lodestone.session import materialise, shared_dir
from lodestone.sources import evidence as ev
from lodestone.sources import files as fs


def _at(df, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/lodestone/{name}-{uuid.uuid4().hex}"


def _texts(df, path, text, repo="'r'"):
    """files (repo_id, path, text) from SQL expressions."""
    return df.select(F.expr(repo).alias("repo_id"), F.expr(path).alias("path"), F.expr(text).alias("text"))


# --- contracts in source text -------------------------------------------------------------------

query("idx22_idl_operations", "IDX-22", "nation", "SELECT concat('Svc', n_nationkey) AS interface, unnest([concat('get_', n_regionkey), 'ping']) AS operation, unnest(['string', 'void']) AS returns FROM nation")(lambda n: ct.idl_operations(_texts(n, "concat('idl/', n_nationkey, '.idl')", "concat('module m {\\n interface Svc', n_nationkey, ' : Base {\\n  string get_', n_regionkey, '(in long a);\\n  void ping ();\\n attribute long x; };\\n};')")).select("interface", "operation", "returns"))
query("idx23_grpc_rpcs", "IDX-23", "nation", "SELECT concat('S', n_nationkey) AS service, unnest(['Get', concat('Put', n_regionkey)]) AS rpc, unnest(['Key', concat('stream ', upper(n_name))]) AS request, unnest(['Value', 'Ack']) AS response FROM nation")(lambda n: ct.proto_rpcs(_texts(n, "concat('p/', n_nationkey, '.proto')", "concat('syntax = \"proto3\";\\nservice S', n_nationkey, ' {\\n  rpc Get(Key) returns (Value);\\n  rpc Put', n_regionkey, ' ( stream ', upper(n_name), ' ) returns(Ack);\\n}\\nmessage Key { string id = 1; }')")).select("service", "rpc", "request", "response"))
query("idx24_protobuf_fields", "IDX-24", "nation", "SELECT concat('M', n_nationkey) AS message, unnest(['id', 'tags', concat('f', n_regionkey)]) AS field, unnest(['string', 'int32', 'Other']) AS type, unnest([1, 2, n_nationkey + 3]) AS number FROM nation")(lambda n: ct.proto_fields(_texts(n, "concat('p/', n_nationkey, '.proto')", "concat('message M', n_nationkey, ' {\\n  string id = 1;\\n  repeated int32 tags = 2;\\n  Other f', n_regionkey, ' = ', n_nationkey + 3, ';\\n}')")).select("message", "field", "type", "number"))
query("idx25_zeromq_endpoints", "IDX-25", "nation", "SELECT concat('z', n_nationkey, '.py') AS path, unnest(['bind', 'connect']) AS role, unnest([concat('tcp://*:', 5000 + n_nationkey), concat('ipc://', lower(n_name))]) AS name FROM nation WHERE n_nationkey % 2 = 0")(lambda n: ct.zeromq_endpoints(_texts(n, "concat('z', n_nationkey, '.py')", "concat(CASE WHEN n_nationkey % 2 = 0 THEN 'import zmq\\n' ELSE '' END, 's.bind(\"tcp://*:', 5000 + n_nationkey, '\")\\ns.connect(''ipc://', lower(n_name), ''')')")).select("path", "role", "name"))
query("idx26_mqtt_links", "IDX-26", "nation", "WITH p AS (SELECT concat('site/', n_regionkey, '/temp/', n_nationkey) AS topic, concat('p', n_nationkey, '.py') AS provider FROM nation), s AS (SELECT concat('s', n_nationkey, '.py') AS consumer, n_regionkey AS r, n_nationkey % 4 AS k, n_nationkey AS n FROM nation) SELECT topic, CASE k WHEN 0 THEN concat('site/', r, '/#') WHEN 1 THEN concat('site/+/temp/', n) WHEN 2 THEN concat('site/', r, '/temp/', n) ELSE concat('site/+/', n) END AS filter, provider, consumer FROM p, s WHERE (k = 0 AND topic LIKE concat('site/', r, '/%')) OR (k = 1 AND topic LIKE concat('site/%/temp/', n)) OR (k = 2 AND topic = concat('site/', r, '/temp/', n))")(lambda n: ct.mqtt_links(ct.mqtt_topics(_texts(n, "concat('p', n_nationkey, '.py')", "concat('import paho.mqtt.client\\nc.publish(\"site/', n_regionkey, '/temp/', n_nationkey, '\", 1)')").unionByName(_texts(n, "concat('s', n_nationkey, '.py')", "concat('from paho.mqtt import client\\nc.subscribe(''', CASE n_nationkey % 4 WHEN 0 THEN concat('site/', n_regionkey, '/#') WHEN 1 THEN concat('site/+/temp/', n_nationkey) WHEN 2 THEN concat('site/', n_regionkey, '/temp/', n_nationkey) ELSE concat('site/+/', n_nationkey) END, ''')')")))))
query("idx27_dbus_interfaces", "IDX-27", "nation", "SELECT concat('d', n_nationkey, '.xml') AS path, unnest(['declares', 'method', 'method']) AS role, unnest([concat('org.x.I', n_nationkey), concat('org.x.I', n_nationkey, '.Get'), concat('org.x.I', n_nationkey, '.Set', n_regionkey)]) AS name FROM nation UNION ALL SELECT concat('u', n_nationkey, '.py'), 'uses', concat('org.x.I', n_nationkey % 7) FROM nation")(lambda n: ct.dbus_interfaces(_texts(n, "concat('d', n_nationkey, '.xml')", "concat('<node><interface name=\"org.x.I', n_nationkey, '\"><method name=\"Get\"/>\\n<method name=\"Set', n_regionkey, '\"></method></interface></node>')").unionByName(_texts(n, "concat('u', n_nationkey, '.py')", "concat('p.Get(dbus_interface=\"org.x.I', n_nationkey % 7, '\")')"))).select("path", "role", "name"))
query("idx21_websocket_events", "IDX-21", "nation", "SELECT concat('w', n_nationkey, '.py') AS path, unnest(['handles', 'client', 'client']) AS role, unnest([concat('join', n_regionkey), 'msg', concat('leave', n_nationkey)]) AS name FROM nation")(lambda n: ct.socket_events(_texts(n, "concat('w', n_nationkey, '.py')", "concat('@sio.on(\"join', n_regionkey, '\")\\ndef f(): pass\\nsocket.on(''msg'')\\nsocket.emit(\"leave', n_nationkey, '\")')")).select("path", "role", "name"))
_CPP = "concat('#include <a.h>\\nstatic int f', n_nationkey, '(int a) {\\n if (a) { return g', n_nationkey, '(a); }\\n return f', n_nationkey, '(0); }\\nint g', n_nationkey, '(int b) {\\n  other(b); return 1; }\\nvoid run() {\\n  f', n_nationkey, '(1); g', n_nationkey, '(2); f', n_nationkey, '(3); }\\n')"
query("idx09_cpp_calls", "IDX-09", "nation", "SELECT concat('c', n_nationkey, '.cpp') AS path, unnest([concat('f', n_nationkey), 'run', 'run']) AS caller, unnest([concat('g', n_nationkey), concat('f', n_nationkey), concat('g', n_nationkey)]) AS callee FROM nation")(lambda n: ct.cpp_calls(ct.cpp_functions(_texts(n, "concat('c', n_nationkey, '.cpp')", _CPP))).select("path", "caller", "callee"))
_CMAKE = "concat('add_library(core', n_nationkey, ' STATIC b.cpp a.cpp)\\nadd_executable( app', n_nationkey, '\\n  main.cpp )\\nenable_testing()\\nadd_test(NAME t', n_nationkey, ' COMMAND app)\\nadd_test(u', n_regionkey, ' app)')"
query("idx09_build_targets", "IDX-09", "nation", "SELECT concat(n_nationkey, '/CMakeLists.txt') AS path, unnest([concat('core', n_nationkey), concat('app', n_nationkey)]) AS target, unnest(['library', 'executable']) AS kind, unnest(['a.cpp,b.cpp', 'main.cpp']) AS sources FROM nation")(lambda n: ct.build_targets(_texts(n, "concat(n_nationkey, '/CMakeLists.txt')", _CMAKE)).select("path", "target", "kind", F.array_join("sources", ",").alias("sources")))
query("idx12_ctest", "IDX-12", "nation", "SELECT concat(n_nationkey, '/CMakeLists.txt') AS path, unnest([concat('t', n_nationkey), concat('u', n_regionkey)]) AS test FROM nation")(lambda n: fs.ctest_commands(_texts(n, "concat(n_nationkey, '/CMakeLists.txt')", _CMAKE)))
_PY = "concat('import os\\nimport pkg', c_custkey % 6, '.m', c_custkey % 40, '\\nfrom . import x\\nfrom ..pkg', (c_custkey + 1) % 6, '.m', c_custkey % 7, ' import y\\nfrom pkg', c_custkey % 6, ' import z\\nfrom .m', c_custkey % 9, ' import w\\n')"
_IMPORTS = """f AS (SELECT DISTINCT concat('src/pkg', c_custkey % 6, '/m', c_custkey, '.py') AS path, c_custkey AS k FROM customer), i0 AS (SELECT concat('src/pkg', c_custkey, '/__init__.py') AS path FROM customer WHERE c_custkey IN (1, 3, 4)), every AS (SELECT path FROM f UNION ALL SELECT path FROM i0),
s AS (SELECT path, k, unnest(['os', concat('pkg', k % 6, '.m', k % 40), '.', concat('..pkg', (k + 1) % 6, '.m', k % 7), concat('pkg', k % 6), concat('.m', k % 9)]) AS m, unnest([[], [concat('src/pkg', k % 6, '/m', k % 40, '.py')], [concat('src/pkg', k % 6, '/__init__.py')], [concat('src/pkg', (k + 1) % 6, '/m', k % 7, '.py')], [concat('src/pkg', k % 6, '/__init__.py')], [concat('src/pkg', k % 6, '/m', k % 9, '.py')]]) AS sought FROM f),
r AS (SELECT path, m, list_filter(sought, lambda x: x IN (SELECT path FROM every))[1] AS found FROM s)"""
_IMPORTS = _IMPORTS.replace("r AS (SELECT path, m, list_filter(sought, lambda x: x IN (SELECT path FROM every))[1] AS found FROM s)", "r AS (SELECT s.path, m, e.path AS found FROM s LEFT JOIN every e ON e.path = sought[1])")


def _python(c):
    own = _texts(c, "concat('src/pkg', c_custkey % 6, '/m', c_custkey, '.py')", _PY)
    return own.unionByName(_texts(c.where("c_custkey in (1, 3, 4)"), "concat('src/pkg', c_custkey, '/__init__.py')", "''"))


query("idx02_imports", "IDX-02", "customer", f"WITH {_IMPORTS} SELECT path, m AS module, CASE WHEN found IS NOT NULL THEN 'resolved_internal' WHEN m LIKE '.%' THEN 'unresolved' ELSE 'external_dependency' END AS status, replace(found, '/__init__.py', '') AS target_path FROM r")(lambda c: ix.imports(ix.python_facts(_python(c))).select("path", F.split_part("target", F.lit(":"), F.lit(1)).alias("module"), "status", "target_path"))
query("idx03_import_edges", "IDX-03", "customer", f"WITH {_IMPORTS} SELECT DISTINCT path AS source, replace(found, '/__init__.py', '') AS target FROM r WHERE found IS NOT NULL")(lambda c: ix.import_edges(ix.imports(ix.python_facts(_python(c)))).select("source", "target"))
query("src16_worktree_ids", "SRC-16", "orders", "WITH g AS (SELECT concat('repo', o_custkey % 50) AS repo_id, string_agg(concat('f', o_orderkey, ':', CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE md5(o_orderstatus) END), '|' ORDER BY concat('f', o_orderkey, ':', CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE md5(o_orderstatus) END)) AS parts FROM orders GROUP BY 1) SELECT repo_id, concat('snap:', repo_id, ':dirty:', substr(sha256(concat(repo_id, '|', 'sha', '|', parts)), 1, 16)) AS snapshot_id FROM g")(lambda o: ct.worktree_ids(o.select(F.expr("concat('repo', o_custkey % 50)").alias("repo_id"), F.lit("sha").alias("git_sha")).distinct(), o.select(F.expr("concat('repo', o_custkey % 50)").alias("repo_id"), F.expr("concat('f', o_orderkey)").alias("path"), F.when(F.col("o_orderkey") % 5 > 0, F.md5("o_orderstatus")).alias("digest"))))
query("idx19_summaries", "IDX-19", "nodes", "SELECT concat('sum:', substr(sha256(concat_ws('|', repo_id, node_id, snapshot_id, coalesce(file_path, ''))), 1, 24)) AS summary_id, NOT (repo_id = 'crm' AND coalesce(file_path, '') IN ('src/crm/c3.py', 'src/crm/c9.py')) AS valid FROM nodes")(lambda n: ct.cached_summaries(n.select("repo_id", F.coalesce("file_path", F.lit("")).alias("file_path"), ct.summary_key(F.col("repo_id"), F.col("node_id"), F.col("snapshot_id"), F.coalesce("file_path", F.lit(""))).alias("summary_id")), n.where("repo_id = 'crm' and file_path in ('src/crm/c3.py', 'src/crm/c9.py')")).select("summary_id", "valid"))
query("src35_build_evidence", "SRC-35", "repo_files", "SELECT path, CASE WHEN path = 'pyproject.toml' THEN 'python' WHEN path = 'Makefile' THEN 'native' ELSE 'ci' END AS evidence, count(*) AS n FROM repo_files WHERE path IN ('pyproject.toml', 'Makefile') OR path LIKE '.github/workflows/%.yml' GROUP BY ALL")(lambda f: fs.build_evidence(f).groupBy("path", "evidence").agg(F.count("*").alias("n")))

# --- files that are written, then read ----------------------------------------------------------


def _written(df, name: str, by: str | None = None):
    """Path of the texts in column value, in a file for each row of by, or in few files."""
    path = _at(df, name)
    if by is None:
        df.select("value").write.text(path)
        return path
    df.select(by, "value").repartition(4, by).write.partitionBy(by).option("maxRecordsPerFile", 1).text(path)
    return path + "/*"


_COVER = "c AS (SELECT concat('src/p', l_partkey % 60, '.py') AS file_path, CAST(l_orderkey % 500 AS INT) AS line, count(*) AS hits FROM lineitem GROUP BY 1, 2)"


def _cover(li):
    return li.groupBy(F.expr("concat('src/p', l_partkey % 60, '.py')").alias("file_path"), (F.col("l_orderkey") % 500).cast("int").alias("line")).agg(F.count("*").alias("hits"))


def _lcov(li):
    rows = _cover(li).groupBy("file_path").agg(F.array_join(F.collect_list(F.expr("concat('DA:', line, ',', hits)")), "\n").alias("da"))
    path = _written(rows.select(F.expr("concat('TN:\\nSF:', file_path, '\\nFN:1,f\\n', da, '\\nend_of_record')").alias("value")), "lcov")
    return ev.read_lcov(li.sparkSession, path)


query("src12_lcov", "SRC-12", "lineitem", f"WITH {_COVER} SELECT * FROM c")(_lcov)


def _cobertura(li):
    rows = _cover(li).groupBy("file_path").agg(F.array_join(F.collect_list(F.expr("concat('<line number=\"', line, '\" hits=\"', hits, '\"/>')")), "").alias("x"))
    xml = rows.select(F.expr("concat('<class name=\"k\" filename=\"', file_path, '\"><methods/><lines>', x, '</lines></class>')").alias("x")).agg(F.expr("concat('<?xml version=\"1.0\"?><coverage><packages><package><classes>', array_join(collect_list(x), ''), '</classes></package></packages></coverage>')").alias("value"))
    return ev.read_cobertura(li.sparkSession, _written(xml, "cobertura"))


query("src13_cobertura", "SRC-13", "lineitem", f"WITH {_COVER} SELECT * FROM c")(_cobertura)


def _sarif_logs(s):
    result = "to_json(named_struct('version', CASE WHEN s_suppkey % 7 = 0 THEN '2.0.0' ELSE '2.1.0' END, 'runs', array(named_struct('tool', named_struct('driver', named_struct('name', 'Semgrep', 'rules', array(named_struct('id', 'r1', 'properties', named_struct('tags', array('CWE-89')))))), 'results', array(named_struct('ruleId', 'r1', 'level', 'error', 'message', named_struct('text', s_name), 'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', concat('src/', s_nationkey, '.py')), 'region', named_struct('startLine', cast(s_suppkey AS int)))))), named_struct('ruleId', 'r2', 'level', 'note', 'message', named_struct('text', 'x'), 'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', 'a.py'), 'region', named_struct('startLine', 3)))))))) ))"
    return s.where("s_suppkey <= 40").select(F.col("s_suppkey").alias("k"), F.expr(f"CASE WHEN s_suppkey % 11 = 0 THEN '{{broken' ELSE {result} END").alias("value"))


query("src07_sarif_logs", "SRC-07 SRC-09 SAR-01", "supplier", "SELECT rule_id, file_path, start_line, message, family, n FROM (SELECT 'r1' AS rule_id, concat('src/', s_nationkey, '.py') AS file_path, CAST(s_suppkey AS INT) AS start_line, s_name AS message, 'sql-injection' AS family, 1 AS n FROM supplier WHERE s_suppkey <= 40 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 UNION ALL SELECT 'r2', 'a.py', 3, 'x', 'other', count(*) FROM supplier WHERE s_suppkey <= 40 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0)")(lambda s: sa.normalize(ev.read_sarif(s.sparkSession, _written(_sarif_logs(s), "sarif", "k"))[0]).groupBy("rule_id", "file_path", "start_line", "message", "family").agg(F.count("*").cast("int").alias("n")))
query("src07_rejected_logs", "SRC-07", "supplier", "SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'malformed' ELSE 'unsupported version' END AS reason, count(*) AS n FROM supplier WHERE s_suppkey <= 40 AND (s_suppkey % 7 = 0 OR s_suppkey % 11 = 0) GROUP BY 1")(lambda s: ev.read_sarif(s.sparkSession, _written(_sarif_logs(s), "sarif", "k"))[1].groupBy("reason").agg(F.count("*").alias("n")))


def _bandit(s):
    one = "to_json(named_struct('results', array(named_struct('test_id', concat('B', 100 + s_nationkey), 'test_name', 't', 'filename', concat('src/', s_suppkey, '.py'), 'line_number', cast(s_suppkey % 90 AS int), 'issue_text', s_name, 'issue_severity', 'HIGH', 'issue_confidence', 'LOW', 'code', 'x'))))"
    path = _written(s.where("s_suppkey <= 40").select(F.col("s_suppkey").alias("k"), F.expr(one).alias("value")), "bandit", "k")
    return ev.bandit_to_alerts(s.sparkSession, path).select("analyser_id", "rule_id", "file_path", "start_line", "message", F.col("props")["issue_severity"].alias("severity"))


query("src11_bandit", "SRC-11", "supplier", "SELECT 'bandit' AS analyser_id, concat('B', 100 + s_nationkey) AS rule_id, concat('src/', s_suppkey, '.py') AS file_path, CAST(s_suppkey % 90 AS INT) AS start_line, s_name AS message, 'HIGH' AS severity FROM supplier WHERE s_suppkey <= 40")(_bandit)
_SHA = "concat(md5(c_mktsegment), substr(md5(c_mktsegment), 1, 8))"
query("src14_blame", "SRC-14 SRC-15", "customer", f"SELECT concat('f', c_custkey, '.py') AS file_path, unnest([1, 2]) AS line, {_SHA} AS commit_sha, c_name AS author, CAST(1700000000 + c_custkey AS VARCHAR) AS author_time, concat('fix ', c_mktsegment) AS summary FROM customer")(lambda c: ev.parse_blame(c.select(F.expr("concat('f', c_custkey, '.py')").alias("file_path"), F.expr(f"concat({_SHA}, ' 1 1 2\\nauthor ', c_name, '\\nauthor-time ', 1700000000 + c_custkey, '\\nsummary fix ', c_mktsegment, '\\nfilename f\\n\\tcode one\\n', {_SHA}, ' 2 2\\n\\tcode two')").alias("text"))))


def _traced(e):
    rows = e.select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type"), F.expr("concat('m', user_id % 4)").alias("module"), F.lit("f").alias("function"), F.expr("concat('src/', user_id, '.py')").alias("file_path"), (F.col("event_id") % 900).cast("int").alias("line_number"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("exception"), F.col("event_id").cast("long").alias("ts_ns"))
    path = _at(e, "traces")
    ev.write_traces(rows, path)
    return ev.read_traces(e.sparkSession, path).select("event_id", "module", "line_number", "ts_ns")


query("src18_traces", "SRC-18", "events", "SELECT CAST(event_id AS VARCHAR) AS event_id, concat('m', user_id % 4) AS module, CAST(event_id % 900 AS INT) AS line_number, event_id AS ts_ns FROM events")(_traced)


def _reread(df, name: str, schema: str):
    path = _at(df, name)
    df.write.json(path)
    return df.sparkSession.read.schema(schema).json(path)


query("src19_telemetry", "SRC-19", "run_events", "SELECT run_id, seq, type, token_count FROM run_events")(lambda e: _reread(e.select("run_id", "seq", "type", "token_count"), "telemetry", "run_id string, seq long, type string, token_count long"))
query("src20_run_records", "SRC-20", "runs", "SELECT run_id, status, repo_id FROM runs")(lambda r: _reread(r.select("run_id", "status", "repo_id"), "records", "run_id string, status string, repo_id string"))


def _exported(e):
    path = _at(e, "ledger")
    ev.export_ledger(e.select("event_id", "ts", "event_type", "props", "value"), path, ["props", "value"], "2024-01-05 00:00:00", "2024-01-20 00:00:00", event_type="click")
    return e.sparkSession.read.json(path).select("event_id", "event_type")


query("src21_ledger_export", "SRC-21", "events", "SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")(_exported)
query("src22_manifest_chunks", "SRC-22", "nodes edges", "WITH n AS (SELECT 'nodes' AS kind, CAST(floor((row_number() OVER (ORDER BY node_id) - 1) / 500) AS BIGINT) AS chunk FROM nodes UNION ALL SELECT 'edges', CAST(floor((row_number() OVER (ORDER BY edge_id) - 1) / 500) AS BIGINT) FROM edges) SELECT kind, chunk, count(*) AS rows FROM n GROUP BY ALL")(lambda n, e: ev.write_manifest(n, e, _at(n, "manifest"), 500).select("kind", "chunk", "rows"))


def _bundled(n, e):
    path = _at(n, "bundle")
    ev.save_bundle({"nodes": n.where("repo_id = 'crm'"), "edges": e.where("repo_id = 'crm'")}, path)
    got = ev.load_bundle(n.sparkSession, path)
    return got["nodes"].select(F.col("node_id").alias("id")).unionByName(got["edges"].select(F.col("edge_id").alias("id")))


query("src24_bundle", "SRC-24", "nodes edges", "SELECT node_id AS id FROM nodes WHERE repo_id = 'crm' UNION ALL SELECT edge_id FROM edges WHERE repo_id = 'crm'")(_bundled)


def _put(spark, path: str, text: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _smoke(r):
    root, spark = _at(r, "smoke"), r.sparkSession
    for k in range(5):
        _put(spark, f"{root}/i{k}/issue.json", json.dumps({"text": f"issue {k}", "language": "python", "repo_id": f"repo:{k}", "difficulty_tags": ["t"], "age_days": 5 * k}))
        _put(spark, f"{root}/i{k}/gold_suspects.json", json.dumps([{"file_path": f"src/{k}.py", "rank": 2, "reason": "x"}, {"file_path": "src/a.py", "rank": 1, "reason": "y"}]))
        _put(spark, f"{root}/i{k}/gold_patch.diff", f"--- a/src/{k}.py\n+++ b/src/{k}.py\n@@ -1 +1 @@\n-a\n+b\n")
    got = ev.read_smoke_suite(spark, root)
    return got.join(r.select("r_regionkey"), F.col("instance") == F.expr("concat('i', r_regionkey)")).select("instance", "age_days", "repo_id", F.array_join("gold_files", ",").alias("gold_files"), F.col("diff").contains("+++ b/src/").alias("has_diff"))


query("src31_smoke_suite", "SRC-31", "region", "SELECT concat('i', r_regionkey) AS instance, 5 * r_regionkey AS age_days, concat('repo:', r_regionkey) AS repo_id, concat('src/a.py,src/', r_regionkey, '.py') AS gold_files, true AS has_diff FROM region")(_smoke)


def _openapi(n):
    doc = "concat('{\"openapi\": \"3.0.0\", \"paths\": {\"/n/', n_nationkey, '/{id}\": {\"get\": {\"operationId\": \"get', n_nationkey, '\"}, \"delete\": {}, \"parameters\": []}, \"/r/', n_regionkey, '\": {\"post\": {\"operationId\": \"p\"}}}}')"
    path = _written(n.select(F.col("n_nationkey").alias("k"), F.expr(doc).alias("value")), "openapi", "k")
    return ev.read_openapi(n.sparkSession, path).select("route", "method", "operation_id")


query("src32_openapi", "SRC-32", "nation", "SELECT unnest([concat('/n/', n_nationkey, '/{id}'), concat('/n/', n_nationkey, '/{id}'), concat('/r/', n_regionkey)]) AS route, unnest(['GET', 'DELETE', 'POST']) AS method, unnest([concat('get', n_nationkey), NULL, 'p']) AS operation_id FROM nation")(_openapi)


def _commands(n):
    doc = "concat('[{\"directory\": \"/b\", \"file\": \"', n_nationkey, '.cpp\", \"arguments\": [\"cc\", \"-Iinc', n_regionkey, '\", \"-DX=', n_nationkey, '\", \"-std=c++20\"]}, {\"directory\": \"/b\", \"file\": \"z', n_nationkey, '.c\", \"command\": \"cc -Ia -Ib\"}]')"
    path = _written(n.select(F.col("n_nationkey").alias("k"), F.expr(doc).alias("value")), "commands", "k")
    return fs.compile_commands(n.sparkSession, path).select("file", F.array_join("includes", ",").alias("includes"), F.array_join("defines", ",").alias("defines"), "standard")


query("src33_compile_commands", "SRC-33", "nation", "SELECT unnest([concat(n_nationkey, '.cpp'), concat('z', n_nationkey, '.c')]) AS file, unnest([concat('inc', n_regionkey), 'a,b']) AS includes, unnest([concat('X=', n_nationkey), '']) AS defines, unnest(['c++20', NULL]) AS standard FROM nation")(_commands)


def _packages(n):
    doc = "concat('{\"name\": \"p', n_nationkey, '\", \"dependencies\": {\"lib', n_regionkey, '\": \"^1.0\"}, \"devDependencies\": {\"jest\": \"29\"}}')"
    return fs.package_json(n.sparkSession, _written(n.select(F.col("n_nationkey").alias("k"), F.expr(doc).alias("value")), "package", "k"))


query("src34_package_json", "SRC-34", "nation", "SELECT concat('p', n_nationkey) AS name, unnest([concat('lib', n_regionkey), 'jest']) AS dependency, unnest(['^1.0', '29']) AS version, unnest([false, true]) AS dev, unnest([false, true]) AS test_runner FROM nation")(_packages)
query("str11_callgrind", "STR-11", "nation", "SELECT concat('t', n_nationkey) AS trace_id, unnest(['main', concat('work', n_regionkey)]) AS function, unnest([1, 0])::BIGINT AS calls, unnest([7 + n_nationkey, 5])::BIGINT AS cost FROM nation")(lambda n: ev.parse_callgrind(n.select(F.expr("concat('t', n_nationkey)").alias("trace_id"), F.expr("concat('events: Ir\\nfl=a.c\\nfn=main\\n10 ', 3 + n_nationkey, '\\n11 4\\ncfn=work\\ncalls=2 20\\n12 90\\nfn=(2) work', n_regionkey, '\\n20 5')").alias("text"))))


def _hashed(p):
    rows = materialise(p.where("p_partkey <= 50").select(F.col("p_partkey").alias("k"), F.expr("concat('body ', p_partkey, ' ', p_name)").alias("value")), "bodies")
    path = _written(rows, "bodies", "k").removesuffix("/*")
    got = fs.read_files(p.sparkSession, path).where("path like 'k=%'")
    return got.select(F.regexp_extract("path", "k=([0-9]+)/", 1).cast("long").alias("k"), "sha256", "length")


query("src06_file_hashes", "SRC-06", "part", "SELECT p_partkey AS k, sha256(concat('body ', p_partkey, ' ', p_name, chr(10))) AS sha256, length(concat('body ', p_partkey, ' ', p_name)) + 1 AS length FROM part WHERE p_partkey <= 50")(_hashed)

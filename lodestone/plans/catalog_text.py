"""Further queries: texts, files, gates and tasks, over documents that the driver's tables are turned into."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import gates as gt
from lodestone.operators import graph as gr
from lodestone.operators import indexers as ix
from lodestone.plans.registry import query
from lodestone.sources import evidence as se
from lodestone.sources import files as sf
from lodestone.streaming import monitors as mo

AS_OF = "timestamp'2024-02-01 00:00:00'"



def _spec(p):
    return p.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("# Part "), "p_name", F.lit("\nThe "), "p_brand", F.lit(" must log. It may stop.\nIt shall emit:\n- `"), F.lit("mod_"), F.col("p_size").cast("string"), F.lit("` runs\n\n| Size | Type |\n|---|---|\n| "), F.col("p_size").cast("string"), F.lit(" | "), "p_type", F.lit(" |\n## Notes ##\n")).alias("text"))


query("win09_normative_clauses", "WIN-09 FUN-13 FUN-17", "part", "SELECT p_partkey AS doc_id, 1 AS line_no, concat('The ', p_brand, ' must log.') AS clause, true AS atomic FROM part")(lambda p: tx.normative_clauses(_spec(p)).select("doc_id", "line_no", "clause", "atomic"))
query("win10_table_clauses", "WIN-10 FUN-13", "part", "SELECT p_partkey AS doc_id, concat('Size: ', p_size, '; Type: ', p_type) AS clause FROM part")(lambda p: tx.table_clauses(_spec(p)).select("doc_id", "clause"))
query("fun13_bullet_clauses", "FUN-13 GRF-16", "part", "SELECT p_partkey AS doc_id, concat('`mod_', p_size, '` runs') AS clause FROM part")(lambda p: tx.bullet_clauses(_spec(p)).select("doc_id", "clause"))
query("idx07_markdown_headings", "IDX-07", "part", "SELECT p_partkey AS doc_id, 1 AS level, concat('Part ', p_name) AS title FROM part UNION ALL SELECT p_partkey, 2, 'Notes' FROM part")(lambda p: ix.markdown_headings(_spec(p).select(F.col("doc_id").alias("repo_id"), F.lit("a.md").alias("path"), "text")).select(F.col("repo_id").alias("doc_id"), "level", "title"))


def _diffs(li):
    body = F.concat(F.lit("--- a/f\n+++ b/src/p"), (F.col("l_partkey") % 9).cast("string"), F.lit(".py\n@@ -"), F.col("l_linenumber").cast("string"), F.lit(",2 +"), (F.col("l_linenumber") + 1).cast("string"), F.lit(",3 @@\n-old\n+new"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("\n+if x:")).otherwise(F.lit("\n+def f(a, b):")))
    return li.where("l_orderkey % 20 = 0").groupBy(F.col("l_orderkey").cast("string").alias("diff_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", body.alias("b")))), lambda x: x["b"]), "\n").alias("diff"))


_LI = "FROM lineitem WHERE l_orderkey % 20 = 0 GROUP BY l_orderkey"
query("win11_diff_totals", "WIN-11 AGG-29 FUN-30", "lineitem", f"SELECT CAST(l_orderkey AS VARCHAR) AS diff_id, 2 * count(*) AS added, count(*) AS removed, count(DISTINCT l_partkey % 9) AS files, count(*) AS hunks, count(*) AS net {_LI}")(lambda li: tx.diff_totals(_diffs(li)))
query("fun04_diff_files", "FUN-04 FUN-05", "lineitem", f"SELECT CAST(l_orderkey AS VARCHAR) AS diff_id, CAST(count(DISTINCT l_partkey % 9) AS INT) AS files_touched {_LI}")(lambda li: _diffs(li).select("diff_id", F.size(tx.diff_files(F.col("diff"))).alias("files_touched")))
query("fun06_maintainability", "FUN-06 FUN-31", "lineitem", f"SELECT CAST(l_orderkey AS VARCHAR) AS diff_id, round(greatest(0, 1 - (count(DISTINCT l_partkey % 9) - 1) * 0.2)::DOUBLE, 6) AS locality, count(*) FILTER (l_linenumber % 2 = 1) <= 10 AS passed {_LI}")(lambda li: _diffs(li).select("diff_id", tx.maintainability(F.col("diff")).alias("m")).select("diff_id", F.round("m.locality", 6).alias("locality"), "m.passed"))
query("fun07_diff_features", "FUN-07 FUN-08", "lineitem", f"SELECT CAST(l_orderkey AS VARCHAR) AS diff_id, 3 * count(*) AS edit_distance, CASE WHEN bool_or(l_linenumber % 2 = 0) THEN 'conditional_inserted' ELSE 'signature_change' END AS edit_operation, bool_or(l_linenumber % 2 = 1) AS signature_changed, CAST(count(*) FILTER (l_linenumber % 2 = 1) AS INT) AS parameter_delta {_LI}")(lambda li: tx.diff_features(_diffs(li)).select("diff_id", "edit_distance", "edit_operation", "signature_changed", "parameter_delta"))
query("rnk02_stack_frames", "RNK-02 RNK-01 WIN-12", "nation", "SELECT n_nationkey, concat('src/', lower(n_name), '.py:', n_nationkey, ',lib/x.ts:7') AS frames, 'ValueError' AS errors FROM nation")(lambda n: n.select("n_nationkey", F.concat(F.lit('boom\n  File "src/'), F.lower("n_name"), F.lit('.py", line '), F.col("n_nationkey").cast("string"), F.lit(", in f\n    at run (lib/x.ts:7:1)\nValueError: bad\n")).alias("t")).select("n_nationkey", F.array_join(tx.stack_frames(F.col("t")), ",").alias("frames"), F.array_join(tx.error_strings(F.col("t")), ",").alias("errors")))
query("src05_classified_files", "SRC-05 SRC-04 SRC-35", "nodes", "SELECT file_path AS path, 'python' AS language, starts_with(file_path, 'tests/') AS is_test, count(*) AS n FROM nodes WHERE file_path IS NOT NULL GROUP BY file_path")(lambda n: sf.classified(n.where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))).select("path", "language", "is_test", "n"))
query("src04_folders", "SRC-04 IDX-17", "nodes", "WITH f AS (SELECT DISTINCT file_path AS p FROM nodes WHERE file_path IS NOT NULL), d AS (SELECT DISTINCT string_split(p, '/')[1] AS path FROM f UNION SELECT DISTINCT concat(string_split(p, '/')[1], '/', string_split(p, '/')[2]) FROM f WHERE len(string_split(p, '/')) > 2) SELECT path, 'directory' AS kind FROM d UNION ALL SELECT p, 'file' FROM f")(lambda n: sf.folder_nodes(n.where("file_path is not null").select(F.col("file_path").alias("path")).distinct()))
query("src08_artifact_paths", "SRC-08", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('src/a b', c_custkey, '.py') WHEN c_custkey % 3 = 1 THEN concat('src/', c_custkey, '.py') END AS path FROM customer")(lambda c: c.select("c_custkey", se.artifact_path(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("file:///w/r/src/a%20b"), F.col("c_custkey").cast("string"), F.lit(".py"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("./src/"), F.col("c_custkey").cast("string"), F.lit(".py"))).otherwise("/else/x.py"), F.lit(None).cast("string"), "/w/r").alias("path")))
query("flt11_trace_scope", "FLT-11 FLT-12", "nodes", "SELECT repo_id, count(*) AS n, count(*) FILTER (repo_id NOT IN ('geo','supply') AND file_path LIKE '%src/%') AS kept FROM nodes GROUP BY repo_id")(lambda n: n.withColumn("k", se.in_scope(F.col("repo_id"), F.col("file_path"), ["geo"], ["src/"], ["supply"])).groupBy("repo_id").agg(F.count("*").alias("n"), F.count_if("k").alias("kept")))


def _calls(li):
    return li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("call_id"), F.when(F.col("l_returnflag") == "A", "reader").when(F.col("l_returnflag") == "N", "writer").otherwise("ghost").alias("profile"), F.when(F.col("l_linenumber") % 4 == 0, "edit").when(F.col("l_linenumber") % 4 == 1, "read").when(F.col("l_linenumber") % 4 == 2, "commit").otherwise("execute").alias("category"), F.when(F.col("l_partkey") % 2 == 0, "src/x").otherwise("etc/x").alias("path"), (F.col("l_suppkey") % 5 == 0).alias("network"))


def _policy(li):
    profiles = li.sparkSession.createDataFrame([("reader", ["read"], ["edit"], [], False), ("writer", ["read", "edit", "execute"], ["commit"], ["src/"], True)], "profile string, allowed array<string>, needs_approval array<string>, paths array<string>, network_allowed boolean")
    return gt.tool_policy(_calls(li), profiles).groupBy("action", "reason").agg(F.count("*").alias("n"))


query("flt14_tool_policy", "FLT-14 FLT-24 FUN-25", "lineitem", """WITH c AS (SELECT l_returnflag AS f, l_linenumber % 4 AS k, l_partkey % 2 = 0 AS src, l_suppkey % 5 = 0 AS net FROM lineitem), r AS (SELECT CASE WHEN f NOT IN ('A','N') THEN 'profile' WHEN f = 'A' AND net THEN 'network' WHEN f = 'A' AND k = 0 THEN 'approval' WHEN f = 'A' AND k <> 1 THEN 'category' WHEN f = 'N' AND k = 2 THEN 'approval' WHEN f = 'N' AND k IN (0, 3) AND NOT src THEN 'path' END AS reason FROM c)
SELECT CASE WHEN reason IS NULL THEN 'allow' WHEN reason = 'approval' THEN 'approval_required' ELSE 'deny' END AS action, reason, count(*) AS n FROM r GROUP BY ALL""")(_policy)
query("flt20_refresh_admission", "FLT-20 FLT-19", "orders", "SELECT coalesce(CASE WHEN o_orderkey % 2 = 1 THEN 'approval' WHEN o_orderkey % 3 = 0 THEN 'gold' WHEN o_orderkey % 5 = 0 THEN 'fail_to_pass' WHEN o_orderkey % 7 = 0 THEN 'relevance' WHEN o_orderkey % 11 = 0 THEN 'flaky' END, 'admitted') AS reject, count(*) AS n FROM orders GROUP BY 1")(lambda o: gt.admitted(o.select((F.col("o_orderkey") % 2 == 0).alias("approved"), (F.col("o_orderkey") % 3 != 0).alias("gold_hidden"), (F.col("o_orderkey") % 5 != 0).alias("fail_to_pass"), (F.col("o_orderkey") % 7 != 0).alias("relevant"), (F.col("o_orderkey") % 11 == 0).alias("flaky"))).groupBy(F.coalesce("reject", F.lit("admitted")).alias("reject")).agg(F.count("*").alias("n")))
query("flt23_answer_gates", "FLT-23 RNK-16 RNK-11", "orders", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 4 = 0 THEN 'heuristic' WHEN o_orderkey % 5 = 0 THEN 'analyser' ELSE 'parser' END AS confidence, count(*) AS n FROM orders GROUP BY 1")(lambda o: o.groupBy(gt.answer_confidence(F.col("o_orderkey") % 3, F.when(F.col("o_orderkey") % 4 == 0, "behaviour_trace").otherwise("file_location"), F.col("o_orderkey") % 5 == 0, F.lit("parser"), False).alias("confidence")).agg(F.count("*").alias("n")))
query("top14_question_class", "TOP-14 RNK-13", "nation", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'behaviour_trace' WHEN 1 THEN 'file_location' ELSE 'unknown' END AS best, CASE n_nationkey % 3 WHEN 0 THEN 'file_location' WHEN 1 THEN 'interface_contract' END AS runner_up FROM nation")(lambda n: n.select("n_nationkey", gt.question_class(F.when(F.col("n_nationkey") % 3 == 0, "How does it happen in which module").when(F.col("n_nationkey") % 3 == 1, "Where is the file of the api").otherwise("Name it")).alias("q")).select("n_nationkey", "q.best", "q.runner_up"))
query("rnk23_memory_gate", "RNK-23 RNK-24", "labels", "SELECT round(100 * (avg(CAST(quality AS DOUBLE)) FILTER (doc_id % 2 = 0) - avg(CAST(quality AS DOUBLE)) FILTER (doc_id % 2 = 1)), 6) AS delta_pp, 100 * (avg(CAST(quality AS DOUBLE)) FILTER (doc_id % 2 = 0) - avg(CAST(quality AS DOUBLE)) FILTER (doc_id % 2 = 1)) >= 3 AS ship FROM labels")(lambda l: gt.memory_gate(l.select((F.col("doc_id") % 2 == 0).alias("memory"), (F.col("quality") == 1).alias("passed"))).withColumn("delta_pp", F.round("delta_pp", 6)))
query("fun32_audit_axes", "FUN-32 FUN-28", "labels", "SELECT axis, count(*) FILTER (p) AS passed, count(*) AS n FROM (SELECT unnest(['correctness','security','maintainability','process']) AS axis, unnest([quality = 1, toxic = 0, doc_id % 2 = 0, true]) AS p FROM labels) GROUP BY axis")(lambda l: gt.audit_axes(l.select(F.col("doc_id").alias("review_id"), (F.col("quality") == 1).alias("correctness"), (F.col("toxic") == 0).alias("security"), (F.col("doc_id") % 2 == 0).alias("maintainability"), F.lit(True).alias("process"))).groupBy("axis").agg(F.count_if("passed").alias("passed"), F.count("*").alias("n")))
query("str07_task_expiry", "STR-07", "events", "SELECT CASE WHEN event_type IN ('click','view') AND epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) > 86400 * (event_id % 30) THEN 'expired' WHEN event_type IN ('click','view') THEN 'pending' ELSE 'done' END AS state, count(*) AS n FROM events GROUP BY 1")(lambda e: mo.tasks_at(e.select(F.col("event_id").alias("task_id"), F.when(F.col("event_type").isin("click", "view"), "pending").otherwise("done").alias("state"), F.col("ts").alias("created_ts"), (F.col("event_id") % 30 * 86400).alias("ttl_s")), F.expr(AS_OF)).groupBy("state").agg(F.count("*").alias("n")))
query("grf13_linked_documents", "GRF-13", "edges", "SELECT edge_id, CASE WHEN source_id = 'part:3' THEN target_id ELSE source_id END AS document_id, CASE WHEN confidence >= 0.9 THEN 'parser' ELSE 'heuristic' END AS grade FROM edges WHERE edge_type = 'consumes' AND (source_id = 'part:3' OR target_id = 'part:3')")(lambda e: gr.linked_documents(e.withColumn("edge_type", F.when(F.col("edge_type") == "consumes", "documents").otherwise(F.col("edge_type"))), "part:3"))


def _sources(n):
    py = F.concat(F.lit("@app.get('/r/"), F.col("n_regionkey").cast("string"), F.lit("/<int:id>')\ndef h"), F.col("n_nationkey").cast("string"), F.lit("():\n    return 1\n"))
    ts = F.concat(F.lit("import a from './b'\nexport class C"), F.col("n_nationkey").cast("string"), F.lit(" {}\nclient.get('/r/"), F.col("n_regionkey").cast("string"), F.lit("/{id}')\n"))
    return n.select(F.lit("r").alias("repo_id"), F.concat(F.lit("s/h"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), py.alias("text")).unionByName(n.select(F.lit("r").alias("repo_id"), F.concat(F.lit("c/k"), F.col("n_nationkey").cast("string"), F.lit(".ts")).alias("path"), ts.alias("text")))


query("idx20_interface_links", "IDX-20 IDX-21 RNK-18", "nation", "SELECT concat('s/h', a.n_nationkey, '.py') AS provider, concat('c/k', b.n_nationkey, '.ts') AS consumer, concat('/r/', a.n_regionkey, '/{id}') AS name FROM nation a JOIN nation b USING (n_regionkey)".replace("a.n_regionkey, '/{id}'", "n_regionkey, '/{id}'"))(lambda n: ix.interface_links(ix.interfaces(_sources(n), "http")).select("provider", "consumer", "name"))
query("idx08_typescript_symbols", "IDX-08", "nation", "SELECT concat('c/k', n_nationkey, '.ts') AS path, 'class' AS kind, concat('C', n_nationkey) AS name FROM nation UNION ALL SELECT concat('c/k', n_nationkey, '.ts'), 'import', './b' FROM nation")(lambda n: ix.regex_symbols(_sources(n), "typescript").select("path", "kind", "name"))
query("idx01_python_definitions", "IDX-01 EXT-01", "nation", "SELECT concat('s.h', n_nationkey, '.h', n_nationkey) AS qualified, 2 AS start_line, 3 AS end_line FROM nation")(lambda n: ix.python_facts(_sources(n)).where("kind = 'function'").select("qualified", "start_line", "end_line"))
query("idx18_incremental_index", "IDX-18 STR-13", "nodes", "SELECT node_id AS key FROM nodes WHERE snapshot_id = 'snap:0' UNION ALL SELECT node_id FROM nodes WHERE snapshot_id <> 'snap:0' AND file_path LIKE 'src/crm/c1%'")(lambda n: ix.incremental(n.where("snapshot_id = 'snap:0'").select(F.col("node_id").alias("key")), n.select(F.col("node_id").alias("key"), F.col("file_path").alias("path")), n.where("file_path like 'src/crm/c1%'").select(F.col("file_path").alias("path")).distinct()))

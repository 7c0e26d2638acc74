"""Readers and writers by round trip."""

import gzip
import json

from pyspark.sql import functions as F

from lodestone.operators import sarif as sa
from lodestone.sources import evidence as e
from lodestone.sources import files as f


def test_sarif_to_alerts(spark, tmp_path):
    log = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "Semgrep", "rules": [{"id": "sqli", "properties": {"tags": ["CWE-89"]}}]}}, "results": [{"ruleId": "sqli", "level": "error", "message": {"text": "bad  query"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "src/a.py"}, "region": {"startLine": 16}}}]}]}, {"tool": {"driver": {"name": "other"}}, "results": []}]}
    (tmp_path / "a.json").write_text(json.dumps(log))
    (tmp_path / "b.json").write_text("{ not json")
    (tmp_path / "c.json").write_text(json.dumps({"version": "1.0", "runs": []}))
    logs, bad = e.read_sarif(spark, str(tmp_path))
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "unsupported version"]
    r = sa.normalize(logs).first()
    assert (r.severity, r.family, r.cwe_ids, r.start_line, r.suppressed) == ("high", "sql-injection", ["CWE-89"], 16, False)
    assert r.alert_id == "semgrep:" + r.fingerprint and len(r.fingerprint) == 16 and len(r.partial) == 8


def test_artifact_paths(spark):
    d = spark.createDataFrame([("file:///w/r/src/a%20b.py",), ("src/x.py",), ("/other/y.py",), ("./z.py",)], "u string")
    assert [r.p for r in d.select(e.artifact_path(F.col("u"), F.lit(None).cast("string"), "/w/r").alias("p")).collect()] == ["src/a b.py", "src/x.py", None, "z.py"]


def test_coverage(spark, tmp_path):
    (tmp_path / "l.info").write_text("TN:\nSF:src/app.py\nDA:1,3\nDA:2,0\nend_of_record\nSF:cut.py\nDA:9,9\n")
    assert [tuple(r) for r in e.read_lcov(spark, str(tmp_path / "l.info")).orderBy("line").collect()] == [("src/app.py", 1, 3), ("src/app.py", 2, 0)]
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert [tuple(r) for r in e.read_cobertura(spark, str(tmp_path / "c.xml")).orderBy("line").collect()] == [("a.py", 1, 2), ("a.py", 2, 0)]


def test_blame(spark):
    sha = "a" * 40
    text = f"{sha} 1 1 2\nauthor Al\nauthor-time 170\nsummary fix it\n\tx = 1\n{sha} 2 2\n\ty = 2\n"
    d = spark.createDataFrame([("a.py", text), ("b.py", None)], "file_path string, text string")
    assert [(r.line, r.author, r.author_time, r.summary) for r in e.parse_blame(d).collect()] == [(1, "Al", "170", "fix it"), (2, "Al", "170", "fix it")]


def test_ledger_export(spark, tmp_path):
    d = spark.createDataFrame([("a", "2024-01-01", "s"), ("b", "2024-03-01", "s")], "id string, ts string, secret string").withColumn("ts", F.to_timestamp("ts"))
    e.export_ledger(d, str(tmp_path / "o"), ["secret"], date_to="2024-02-01")
    rows = [json.loads(x) for p in (tmp_path / "o").glob("*.gz") for x in gzip.open(p, "rt")]
    assert [r["id"] for r in rows] == ["a"] and "secret" not in rows[0]


def test_manifest_and_bundle(spark, tmp_path):
    nodes = spark.range(25).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"))
    edges = spark.range(7).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("edge_id"))
    m = e.write_manifest(nodes, edges, str(tmp_path / "m"), 10)
    assert sorted((r.kind, r.chunk, r.rows) for r in m.collect()) == [("edges", 0, 7), ("nodes", 0, 10), ("nodes", 1, 10), ("nodes", 2, 5)]
    e.save_bundle({"nodes": nodes, "edges": edges}, str(tmp_path / "b"))
    assert {k: v.count() for k, v in e.load_bundle(spark, str(tmp_path / "b")).items()} == {"nodes": 25, "edges": 7}


def test_repository_files(spark, tmp_path):
    for p, t in (("src/p/__init__.py", ""), ("src/p/a.py", "x"), ("tests/test_a.py", ""), ("node_modules/q.js", ""), ("package.json", '{"name": "n", "devDependencies": {"jest": "1"}}'), ("compile_commands.json", '[{"directory": "/b", "file": "m.cpp", "arguments": ["cc", "-Iinc", "-DX=1", "-std=c++20"]}]')):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    d = f.read_files(spark, str(tmp_path)).persist()
    c = {r.path: r for r in f.classified(d).collect()}
    assert c["src/p/a.py"].language == "python" and c["tests/test_a.py"].is_test and c["node_modules/q.js"].ignored and not c["src/p/a.py"].ignored
    assert {r.path for r in f.folder_nodes(d).where("kind = 'directory'").collect()} == {"src", "src/p", "tests", "node_modules"}
    assert [r.package for r in f.packages(d).collect()] == ["src/p"]
    assert [(r.dependency, r.dev, r.test_runner) for r in f.package_json(spark, str(tmp_path / "package.json")).collect()] == [("jest", True, True)]
    r = f.compile_commands(spark, str(tmp_path / "compile_commands.json")).first()
    assert (r.includes, r.defines, r.standard) == (["inc"], ["X=1"], "c++20")


def test_scope(spark):
    d = spark.createDataFrame([("app.x", "app/x.py"), ("os.path", "os.py"), ("req", "/site-packages/req.py"), ("bad.y", "bad/y.py")], "m string, p string")
    assert [r.k for r in d.select(e.in_scope(F.col("m"), F.col("p"), ["bad"], ["app"], ["os"]).alias("k")).collect()] == [True, False, False, False]


def test_traces_are_written_whole(spark, tmp_path):
    rows = spark.range(30000).select(F.col("id").cast("string").alias("event_id"), F.lit("call").alias("event_type"), F.when(F.col("id") % 50 > 0, "m").alias("module"), F.repeat(F.lit("f"), 400).alias("function"), F.lit("a.py").alias("file_path"), F.lit(1).alias("line_number"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("exception"), F.col("id").alias("ts_ns"))
    e.write_traces(rows, str(tmp_path / "whole"))
    got = e.read_traces(spark, str(tmp_path / "whole"))
    assert got.exceptAll(rows).count() == 0 and got.count() == 30000
    e.write_traces(rows, str(tmp_path / "cut"), most=1 << 20)
    cut = spark.read.json(str(tmp_path / "cut"))
    assert 0 < cut.where("module = 'm' and truncated").count() < 2200 and cut.where("module is null and not truncated").count() == 600

"""Streaming operators over file streams, run to the end."""

from lodestone.streaming import monitors as m


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def test_risk_events_fire_once(spark, tmp_path):
    rows = [("r", i, "tool_call", "t", "{}", False, None, None) for i in range(7)] + [("r", 10 + i, "gate", "g", None, None, False, False) for i in range(3)] + [("q", i, "gate", "g", None, None, i == 1, False) for i in range(3)]
    s = stream(spark, tmp_path / "s", rows, "run_id string, seq long, kind string, name string, args string, denied boolean, passed boolean, evidence_changed boolean")
    got = sorted((r.run_id, r.pattern, r.risk_score) for r in run(m.risk_events(s), "risk"))
    assert got == [("r", "repeated_failing_gate_no_change", 0.5), ("r", "repeated_identical_tool_calls", 0.5)]


def test_numbers_and_budget(spark, tmp_path):
    s = stream(spark, tmp_path / "n", [("r", f"e{i}", i, 40) for i in range(3)], "run_id string, event_id string, ts long, token_count long")
    assert sorted((r.event_id, r.seq) for r in run(m.numbered(s), "numbered")) == [("e0", 1), ("e1", 2), ("e2", 3)]
    assert [(r.tokens_used, r.status) for r in run(m.budget_status(s, 140), "budget", "complete")] == [(120, "soft_warning")]


def test_debounce_and_upsert(spark, tmp_path):
    rows = [("r", f"p{i % 2}", i) for i in (0, 1, 2, 9)]
    d = spark.createDataFrame(rows, "repo_id string, path string, s int").selectExpr("repo_id", "path", "timestamp_seconds(s) as ts")
    assert sorted(r.events for r in m.debounce(d).collect()) == [1, 3]
    sink = m.upsert_sink(str(tmp_path / "u"), ["repo_id"], "ts")
    sink(d, 0)
    sink(d.selectExpr("repo_id", "'new' as path", "timestamp_seconds(99) as ts"), 1)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "u" / "v=1")).collect()] == ["new"]


def test_state_machine(spark):
    d = spark.createDataFrame([("r", i, s) for i, s in enumerate(["investigate", "plan", "verify"])], "run_id string, seq int, state string")
    assert [r.valid for r in m.state_machine(d).orderBy("seq").collect()] == [True, True, False]

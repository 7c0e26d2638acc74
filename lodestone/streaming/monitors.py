"""Incremental operators as Structured Streaming (STR). Each takes a streaming or a static DataFrame where semantics allow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RISK_THRESHOLDS = {"repeated_identical_tool_calls": 5, "repeated_failing_gate_no_change": 3, "denied_operation_storm": 5, "budget_exhaustion_pattern": 2}


def debounce(changes: DataFrame, gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Batches of changed paths by repository: a batch closes when gap passes without a change. changes: repo_id, path, ts."""
    rows = changes.withWatermark("ts", lateness) if changes.isStreaming else changes
    g = rows.groupBy("repo_id", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("events"))
    return g.select("repo_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("flush_ts"), "paths", "events")


def risk_events(events: DataFrame, thresholds: dict[str, int] | None = None, idle_ms: int = 86_400_000) -> DataFrame:
    """One event for each pattern and run, when its count first reaches its threshold.

    events: run_id, seq, kind (tool_call, gate, budget_hard_stop), name, args, denied, passed,
    evidence_changed. State is counters by hash of a call, kept only until that pattern was emitted, the length of the
    current streak of each gate, and what was emitted. A run idle for idle_ms is forgotten.
    """
    limit = RISK_THRESHOLDS | (thresholds or {})

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        import json
        from zlib import crc32

        if state.hasTimedOut:
            state.remove()
            return
        calls, denied, stops, gates, done = (json.loads(state.get[0]) if state.exists else [{}, 0, 0, {}, []])
        out = []

        def emit(pattern: str, count: int) -> None:
            if pattern not in done and count >= limit[pattern]:
                done.append(pattern)
                out.append((key[0], pattern, min(1.0, count / (2 * limit[pattern]))))

        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            if r.kind == "tool_call":
                denied += bool(r.denied)
                if "repeated_identical_tool_calls" not in done:
                    b = f"{r.name}:{r.args}".encode()
                    k = f"{crc32(b):08x}{crc32(b, 1):08x}"
                    calls[k] = calls.get(k, 0) + 1
                    emit("repeated_identical_tool_calls", calls[k])
                emit("denied_operation_storm", denied)
            elif r.kind == "gate":
                # Only the unbroken tail of failures without new evidence matters.
                if r.passed or r.evidence_changed:
                    gates = {}
                else:
                    gates[r.name] = gates.get(r.name, 0) + 1
                emit("repeated_failing_gate_no_change", gates.get(r.name, 0))
            elif r.kind == "budget_hard_stop":
                stops += 1
                emit("budget_exhaustion_pattern", stops)
        state.update((json.dumps([{} if "repeated_identical_tool_calls" in done else calls, denied, stops, gates, done]),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["run_id", "pattern", "risk_score"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id string, pattern string, risk_score double", "memory string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def budget_status(events: DataFrame, tokens: int, soft: float = 0.8) -> DataFrame:
    """Running tokens of each run and their status; run in update mode. events: run_id, token_count."""
    used = events.groupBy("run_id").agg(F.sum("token_count").alias("tokens_used"))
    return used.withColumn("status", F.when(F.col("tokens_used") >= tokens, "hard_stop").when(F.col("tokens_used") >= soft * tokens, "soft_warning").otherwise("ok"))


def numbered(events: DataFrame) -> DataFrame:
    """events (run_id, event_id, ts) with the next sequence number of their run, kept as state."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        state.update((n + len(pdf),))
        yield pd.DataFrame({"run_id": key[0], "event_id": pdf["event_id"], "seq": range(n + 1, n + len(pdf) + 1)})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id string, event_id string, seq long", "n long", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: list[str], order: str):
    """foreachBatch function that keeps the latest row of each key in versions of a Parquet table under path.

    Version folders are named by batch, so a repeated batch overwrites only its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from lodestone.operators.graph_store import upsert

        spark = batch.sparkSession
        have = None
        if batch_id > 0:
            have = spark.read.parquet(f"{path}/v={batch_id - 1}")
        out = upsert(have if have is not None else batch.limit(0), batch, keys, order)
        out.write.mode("overwrite").parquet(f"{path}/v={batch_id}")

    return write


def tasks_at(tasks: DataFrame, as_of) -> DataFrame:
    """State of tasks (task_id, state, created_ts, ttl_s) at a time: open ones past their time to live are expired."""
    late = F.unix_timestamp(as_of) - F.unix_timestamp("created_ts") > F.col("ttl_s")
    return tasks.withColumn("state", F.when(F.col("state").isin("pending", "running") & late, "expired").otherwise(F.col("state")))


TRANSITIONS = {"investigate": ("plan",), "plan": ("patch", "investigate"), "patch": ("verify",), "verify": ("review", "patch"), "review": ("done", "patch")}


def state_machine(steps: DataFrame) -> DataFrame:
    """steps (run_id, seq, state) with valid: whether the step may follow the one before."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("run_id").orderBy("seq"))
    ok = F.col("_b").isNull() & (F.col("state") == "investigate")
    for a, bs in TRANSITIONS.items():
        ok = ok | ((F.col("_b") == a) & F.col("state").isin(*bs))
    return steps.withColumn("_b", before).withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_b")

"""Run ledgers: anomalies, sequences, comparisons, retention (WIN, AGG-21..24, FLT-15/18, SET-01, STR batch forms)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import broadcast_up_to, materialise


def _by_seq():
    return Window.partitionBy("run_id").orderBy("seq")


def repeated_calls(events: DataFrame, least: int = 5) -> DataFrame:
    """Type and stage seen at least so often in a run, with the first five event ids."""
    w = Window.partitionBy("run_id", "type", "stage").orderBy("seq")
    few = events.withColumn("_k", F.row_number().over(w))
    g = few.groupBy("run_id", "type", "stage").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= 5, F.struct("seq", "event_id")))).alias("e"))
    return g.where(F.col("n") >= least).select("run_id", "type", "stage", "n", F.transform("e", lambda x: x["event_id"]).alias("evidence"))


def denial_storms(events: DataFrame, least: int = 3) -> DataFrame:
    """One finding for every whole group of least denials in an unbroken row of them."""
    deny = F.col("policy_action") == "deny"
    island = events.withColumn("_i", F.sum(F.when(deny, 0).otherwise(1)).over(_by_seq())).where(deny)
    k = island.withColumn("_k", F.row_number().over(Window.partitionBy("run_id", "_i").orderBy("seq")) - 1)
    g = k.withColumn("_g", F.floor(F.col("_k") / least)).groupBy("run_id", "_i", "_g").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.array_sort(F.collect_list(F.struct("seq", "event_id"))).alias("e"))
    return g.where(F.col("n") == least).select("run_id", "first_seq", F.transform("e", lambda x: x["event_id"]).alias("evidence"))


def signal_events(events: DataFrame) -> DataFrame:
    """Budget, stale-index and scope findings, one for each event."""
    t = F.col("type")
    kind = F.when(t.isin("budget_warning", "budget_hard_stop"), "budget_exhaustion").when(t.contains("stale_index") | F.lower(t).contains("dirty_worktree"), "stale_index").when(t.contains("out_of_scope") | t.contains("out-of-scope"), "out_of_scope_write")
    severity = F.when((t == "budget_hard_stop") | (kind == "out_of_scope_write"), "error").otherwise("warning")
    return events.select("run_id", "event_id", kind.alias("kind"), severity.alias("severity")).where("kind is not null")


def context_growth(events: DataFrame, least: int = 5) -> DataFrame:
    """Runs that load context at least so often and never gather evidence."""
    g = events.groupBy("run_id").agg(F.count_if(F.col("type") == "context_load").alias("loads"), F.count_if(F.col("type").isin("tool_result", "graph_query", "sarif_result")).alias("evidence"))
    return g.where((F.col("loads") >= least) & (F.col("evidence") == 0)).select("run_id", "loads")


def failing_gates(events: DataFrame, least: int = 3) -> DataFrame:
    """Gates that failed so often in a run without any code change."""
    changed = F.bool_or(F.col("type").contains("code_change") | F.col("type").contains("diff_snapshot")).over(Window.partitionBy("run_id"))
    quiet = events.withColumn("_c", changed).where((F.col("type") == "gate_failed") & ~F.col("_c"))
    return quiet.groupBy("run_id", "stage").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def anomalies(events: DataFrame) -> DataFrame:
    """(run_id, kind, severity, n) over all checks, cumulative risk among them."""
    parts = [
        repeated_calls(events).select("run_id", F.lit("repeated_tool").alias("kind"), F.lit("warning").alias("severity")),
        denial_storms(events).select("run_id", F.lit("denial_storm").alias("kind"), F.lit("error").alias("severity")),
        signal_events(events).select("run_id", "kind", "severity"),
        context_growth(events).select("run_id", F.lit("context_growth").alias("kind"), F.lit("warning").alias("severity")),
        failing_gates(events).select("run_id", F.lit("repeated_failing").alias("kind"), F.lit("warning").alias("severity")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    counts = every.groupBy("run_id", "kind", "severity").agg(F.count("*").alias("n"))
    return counts.unionByName(cumulative_risk(counts))


def cumulative_risk(counts: DataFrame) -> DataFrame:
    """Runs with two error findings of two kinds."""
    g = counts.where("severity = 'error'").groupBy("run_id").agg(F.sum("n").alias("errors"), F.count_distinct("kind").alias("kinds"))
    return g.where("errors >= 2 and kinds >= 2").select("run_id", F.lit("cumulative_risk").alias("kind"), F.lit("error").alias("severity"), F.lit(1).cast("long").alias("n"))


def stages(events: DataFrame) -> DataFrame:
    """Named stages in order, without immediate repeats."""
    named = events.where("stage <> ''").withColumn("_p", F.lag("stage").over(_by_seq())).where("_p is null or _p <> stage")
    return named.select("run_id", F.row_number().over(_by_seq()).cast("long").alias("pos"), "stage")


def next_sequence(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg((F.count("*") + 1).alias("next_seq"))


def sequence_violations(events: DataFrame) -> DataFrame:
    """Events whose sequence number does not rise over the one before in arrival order (ts, event_id)."""
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    return events.withColumn("previous", F.lag("seq").over(w)).where("previous is not null and seq <= previous").select("run_id", "event_id", "seq", "previous")


def tail_streak(events: DataFrame) -> DataFrame:
    """Length of the streak of failed gates that ends each run's gate events, for its last failing stage."""
    gates = events.where(F.col("type").isin("gate_failed", "gate_passed"))
    back = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    tail = gates.withColumn("_ok", F.sum(F.when(F.col("type") == "gate_passed", 1).otherwise(0)).over(back)).where("_ok = 0")
    last = tail.withColumn("_last", F.first("stage").over(back)).where("stage = _last")
    return last.groupBy("run_id", F.col("stage").alias("gate")).agg(F.count("*").alias("streak"))


def byte_cap(rows: DataFrame, by: str, order: str, text: str, most: int) -> DataFrame:
    """The leading rows of each group whose running size stays within most bytes, rows of equal order counted together; truncated marks cut groups.

    Only sizes are shuffled and summed up. Of each group the first and last order kept then meet the rows where they are.
    """
    size = rows.groupBy(F.col(by).alias("_by"), F.struct(F.col(order).alias("o")).alias("_o")).agg(F.sum(F.octet_length(F.col(text)) + 1).alias("_n"))
    run = size.withColumn("_r", F.sum("_n").over(Window.partitionBy("_by").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.when(F.col("_r") <= most, F.col("_o"))
    ends = run.groupBy("_by").agg((F.sum("_n") > most).alias("truncated"), F.min(fits).alias("_first"), F.max(fits).alias("_last")).where("_last is not null")
    ends = broadcast_up_to(materialise(ends, "cap"), 256)
    kept = rows.drop("truncated").withColumn("_o", F.struct(F.col(order).alias("o"))).join(ends, F.col(by).eqNullSafe(F.col("_by")))
    return kept.where(F.col("_o").between(F.col("_first"), F.col("_last"))).drop("_by", "_o", "_first", "_last")


def compare_runs(events: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row of counts, tokens and time of two runs and their differences."""

    def side(run: Column, p: str) -> list[Column]:
        own = F.col("run_id") == run
        return [
            F.sum(F.when(own, F.col("token_count"))).alias(f"tokens_{p}"),
            F.sum(F.when(own, F.col("wall_ms"))).alias(f"wall_ms_{p}"),
            F.count_if(own & (F.col("policy_action") == "deny")).alias(f"denied_{p}"),
            F.count_if(own & F.col("type").isin("tool_result", "graph_query")).alias(f"evidence_{p}"),
            F.count_if(own & (F.col("type") == "gate_passed")).alias(f"passed_{p}"),
            F.count_if(own & (F.col("type") == "gate_failed")).alias(f"failed_{p}"),
        ]

    g = events.where(F.col("run_id").isin(a, b) if not isinstance(a, Column) else (F.col("run_id") == a) | (F.col("run_id") == b)).agg(*side(a, "a"), *side(b, "b"))
    return g.select("*", *((F.coalesce(f"{k}_b", F.lit(0)) - F.coalesce(f"{k}_a", F.lit(0))).alias(f"{k}_delta") for k in ("tokens", "wall_ms", "denied", "evidence")))


def sequence_diff(events: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """Distinct values of a column in runs a and b: only_a, only_b or common."""
    g = events.where(F.col("run_id").isin(a, b)).groupBy(column).agg(F.bool_or(F.col("run_id") == a).alias("in_a"), F.bool_or(F.col("run_id") == b).alias("in_b"))
    return g.select(F.col(column).alias("value"), F.when(F.col("in_a") & F.col("in_b"), "common").when(F.col("in_a"), "only_a").otherwise("only_b").alias("side"))


def retained(records: DataFrame, kind: str, ts: str, as_of: Column, days: Mapping[str, int]) -> DataFrame:
    """records with expired: older than the days of their kind; unknown kinds and -1 are kept."""
    limit = F.create_map(*(x for k, v in days.items() for x in (F.lit(k), F.lit(v))))[F.col(kind)]
    old = F.unix_timestamp(as_of) - F.unix_timestamp(F.col(ts)) > limit * 86400
    return records.withColumn("expired", F.coalesce((limit >= 0) & old, F.lit(False)))


def running_budget(events: DataFrame, tokens: int | None, calls: int | None, soft: float = 0.8) -> DataFrame:
    """Status after each event: hard_stop at a limit, soft_warning at soft of one, else ok; None is no limit."""
    run = _by_seq().rowsBetween(Window.unboundedPreceding, 0)
    used = events.withColumn("tokens_used", F.sum("token_count").over(run)).withColumn("calls_used", F.sum(F.when(F.col("type") == "tool_call", 1).otherwise(0)).over(run))
    ratio = F.greatest(F.lit(0.0), *([F.col("tokens_used") / tokens] if tokens else []), *([F.col("calls_used") / calls] if calls else [])) if tokens or calls else F.lit(0.0)
    return used.withColumn("status", F.when(ratio >= 1, "hard_stop").when(ratio >= soft, "soft_warning").otherwise("ok"))


def process_compliance(events: DataFrame, required: list[str]) -> DataFrame:
    """Runs with the required event types they miss."""
    g = events.groupBy("run_id").agg(F.collect_set("type").alias("seen"))
    return g.select("run_id", F.array_sort(F.array_except(F.array(*map(F.lit, required)), "seen")).alias("missing")).withColumn("compliant", F.size("missing") == 0)


def recover(cursors: DataFrame, log: DataFrame, as_of: Column, window_s: int) -> DataFrame:
    """Per client and resource: resync without a cursor or when the oldest missed event is beyond the window, else the missed events' number.

    Cursors and distinct log times are sorted together by resource and time. What lies after a cursor is then the running sum
    of its own partition and the totals of later ones, so no cursor meets the events one by one. Of several cursors of a client
    and resource the latest stands.
    """
    points = log.where("resource is not null and ts is not null").groupBy("resource", "ts").agg(F.count("*").alias("n"))
    marks = cursors.groupBy("client", "resource").agg(F.max("last_ts").alias("ts"))
    points = points.select("resource", "ts", F.lit(0).alias("mark"), F.lit(None).cast(marks.schema["client"].dataType).alias("client"), "n")
    both = points.unionByName(marks.select("resource", "ts", F.lit(1).alias("mark"), "client", F.lit(0).cast("long").alias("n")))
    order = ["resource", "ts", "mark", "client"]
    rows = materialise(both.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "recover")
    event = F.when(F.col("mark") == 0, F.col("ts"))
    parts = rows.groupBy("resource", "_p").agg(F.sum("n").alias("n"), F.min(event).alias("oldest"))
    later = Window.partitionBy("resource").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    after = parts.select(F.col("resource").alias("_r"), F.col("_p").alias("_q"), F.sum("n").over(later).alias("_n"), F.min("oldest").over(later).alias("_oldest"))
    own = Window.partitionBy("resource", "_p").orderBy(F.desc("ts"), F.desc("mark"), F.desc("client")).rowsBetween(Window.unboundedPreceding, 0)
    g = rows.withColumn("_own", F.sum("n").over(own)).withColumn("oldest", F.min(event).over(own)).where("mark = 1")
    g = g.join(after, F.col("resource").eqNullSafe(F.col("_r")) & (F.col("_p") == F.col("_q")), "left")
    g = g.select("client", "resource", "ts", (F.col("_own") + F.coalesce("_n", F.lit(0))).alias("later"), F.coalesce("oldest", "_oldest").alias("oldest"))
    late = F.unix_timestamp(as_of) - F.unix_timestamp("oldest") > window_s
    # Without a time a cursor comes before all events of its resource.
    action = F.when(F.col("later") == 0, "none").when(F.col("ts").isNull(), "resync").when(late, "resync").otherwise("replay")
    return g.select("client", "resource", action.alias("action"), F.when(action == "replay", F.col("later")).otherwise(0).alias("replayed"))

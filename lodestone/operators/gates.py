"""Policy, admission and answer gates; question classes; memory and task rules (FLT-14/20/23/24, TOP-14, RNK-16/23, STR-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCES = ("unknown", "heuristic", "analyser", "parser")


def tool_policy(calls: DataFrame, profiles: DataFrame, deny_network: bool = True) -> DataFrame:
    """calls (call_id, profile, category, path, network) with action and reason, by the profile's row.

    profiles: profile, allowed, needs_approval, paths (arrays), network_allowed. Unknown profiles deny.
    """
    j = calls.join(profiles.withColumn("_known", F.lit(True)), "profile", "left")
    outside = F.col("path").isNotNull() & F.col("category").isin("edit", "execute") & (F.size("paths") > 0) & ~F.exists("paths", lambda p: F.col("path").startswith(p))
    allowed = F.array_contains("allowed", F.col("category"))
    reason = F.when(F.col("_known").isNull(), "profile").when(F.col("network") & F.lit(deny_network) & ~F.col("network_allowed"), "network").when(~allowed & F.array_contains("needs_approval", F.col("category")), "approval").when(~allowed, "category").when(outside, "path")
    return j.select("call_id", F.when(reason.isNull(), "allow").when(reason == "approval", "approval_required").otherwise("deny").alias("action"), reason.alias("reason"))


def admitted(records: DataFrame) -> DataFrame:
    """records with reject: the first condition of admission to a suite that fails, null for none."""
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    return records.withColumn("reject", F.when(~ok("approved"), "approval").when(~ok("gold_hidden"), "gold").when(~ok("fail_to_pass"), "fail_to_pass").when(~ok("relevant"), "relevance").when(ok("flaky"), "flaky"))


def capped(confidence: Column, *caps: Column) -> Column:
    """The least of a confidence and the caps that are not null."""
    order = F.array(*map(F.lit, CONFIDENCES))
    rank = lambda c: F.when(c.isNotNull(), F.array_position(order, c))
    return F.element_at(order, F.least(rank(confidence), *map(rank, caps)).cast("int"))


def answer_confidence(evidence: Column, question: Column, stale: Column, confidence: Column, trace_gate: bool) -> Column:
    """An answer's confidence under its gates: no evidence, unproven behaviour traces, stale snapshots."""
    return capped(confidence, F.when(evidence == 0, "unknown"), F.when((question == "behaviour_trace") & ~F.lit(trace_gate), "heuristic"), F.when(stale, "analyser"))


QUESTIONS = (("behaviour_trace", ("how", "happen", "flow", "trace")), ("file_location", ("where", "file", "which")), ("interface_contract", ("api", "route", "endpoint")), ("static_analysis", ("alert", "warning", "cwe")))


def question_class(text: Column) -> Column:
    """struct(best, runner_up) by the number of each class's words in a question; ties keep the order of QUESTIONS."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), F.lit(1)))
    scored = F.array(*(F.struct((-F.size(F.array_intersect(words, F.array(*map(F.lit, ws))))).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, ws) in enumerate(QUESTIONS)))
    top = F.filter(F.array_sort(scored), lambda x: x["s"] < 0)
    return F.struct(F.coalesce(F.get(top, F.lit(0))["name"], F.lit("unknown")).alias("best"), F.get(top, F.lit(1))["name"].alias("runner_up"))


def memory_gate(runs: DataFrame, least_pp: float = 3.0) -> DataFrame:
    """Gain in pass rate, in percentage points, of runs with memory over those without, and whether it suffices. runs: memory, passed."""
    rate = lambda c: F.coalesce(F.avg(F.when(c, F.col("passed").cast("double"))), F.lit(0.0)) * 100
    return runs.agg((rate(F.col("memory")) - rate(~F.col("memory"))).alias("delta_pp")).withColumn("ship", F.col("delta_pp") >= least_pp)


def audit_axes(reviews: DataFrame, axes: tuple[str, ...] = ("correctness", "security", "maintainability", "process")) -> DataFrame:
    """(review_id, axis, passed): one row for each axis of a review, whose columns are booleans."""
    return reviews.select("review_id", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.coalesce(F.col(a), F.lit(False)).alias("passed")) for a in axes))).alias("x")).select("review_id", "x.axis", "x.passed")


def missing_sections(reports: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """(report_id, section) of mandatory headings that a report's text lacks."""
    low = F.lower("text")
    return reports.select("report_id", F.explode(F.array_compact(F.array(*(F.when(~low.contains(s.lower()), s) for s in sections)))).alias("section"))

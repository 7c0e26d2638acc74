"""Repair context of alerts: binding, predicates, suppression, risk, reports (SAR-08, SAR-10 to SAR-16).

alerts: alert_id, rule_id, file_path, line, cwe (a string or null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREDICATES = {
    "injection": ("untrusted input reaches command or query sink", "input is validated or parameterized before the sink", "error"),
    "nullderef": ("nullable value is dereferenced without a guard", "value is checked for null before dereference", "warning"),
}


def family(rule: Column) -> Column:
    """injection, nullderef, or what a rule id begins with."""
    low = F.lower(rule)
    return F.when(low.contains("sql") | low.contains("injection") | low.contains("cwe-89"), "injection").when(low.contains("null") | low.contains("none"), "nullderef").otherwise(F.split_part(low, F.lit("."), F.lit(1)))


def bindings(alerts: DataFrame, snapshot: str | None = None) -> DataFrame:
    """alerts with rule_family, file_node_id, symbol_node_id, confidence and diagnostics (array)."""
    placed = F.coalesce(F.col("file_path"), F.lit("")) != ""
    lined = placed & (F.coalesce("line", F.lit(0)) != 0)
    problems = F.array_compact(F.array(F.when(F.col("file_path").isNull(), "no_location"), F.when(F.lit(snapshot is None), "stale_or_missing_snapshot")))
    return alerts.select(
        "*",
        family(F.coalesce("rule_id", F.lit("unknown"))).alias("rule_family"),
        F.when(placed, F.concat(F.lit("file:"), "file_path")).alias("file_node_id"),
        F.when(lined, F.concat_ws(":", F.lit("symbol"), "file_path", F.col("line").cast("string"))).alias("symbol_node_id"),
        F.when(lined, "parser").otherwise("heuristic").alias("confidence"),
        problems.alias("diagnostics"),
    )


def _lookup(key: Column, at: int) -> Column:
    out = F.lit(None).cast("string")
    for k, v in PREDICATES.items():
        out = F.when(key == k, v[at]).otherwise(out)
    return out


def predicates(bound: DataFrame) -> DataFrame:
    """(alert_id, rule_id, rule_family, predicate, negated, severity, confidence, examples) of bindings."""
    f = F.col("rule_family")
    negated = _lookup(f, 1)
    return bound.select("alert_id", "rule_id", "rule_family", F.coalesce(_lookup(f, 0), F.lit("rule predicate fired")).alias("predicate"), negated.alias("negated"), F.coalesce(_lookup(f, 2), F.lit("warning")).alias("severity"), F.when(negated.isNull(), "heuristic").otherwise("analyser").alias("confidence"), F.when(negated.isNull(), 0).otherwise(1).alias("examples"))


def examples(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """(alert_id, example_id, method): clean examples with the rule and negated predicate of an alert, then those whose rule id holds its family.

    corpus: example_id, rule_id, negated. There is no retrieval by embedding.
    """
    by_predicate = asked.where("negated is not null").join(corpus, ["rule_id", "negated"]).select("alert_id", "example_id", F.lit("predicate_negation").alias("method"))
    c = corpus.select("example_id", F.lower("rule_id").alias("hay"))
    by_family = asked.select("rule_family").distinct().join(c, F.col("hay").contains(F.col("rule_family"))).select("rule_family", "example_id")
    return by_predicate.unionByName(asked.join(by_family, "rule_family").select("alert_id", "example_id", F.lit("rule_family_match").alias("method")))


def suppressions(classified: DataFrame) -> DataFrame:
    """(alert_id, rule_id, annotation, reviewer_required) for likely false positives that a parser or analyser placed."""
    sure = (F.col("classification") == "likely_false_positive") & F.col("confidence").isin("parser", "analyser")
    return classified.where(sure).select("alert_id", "rule_id", F.concat(F.lit("suppress "), "rule_id", F.lit(": reviewed false positive")).alias("annotation"), F.lit(True).alias("reviewer_required"))


def remaining_risk(gone: Column, tests: Column, vulnerability: Column, proof: Column) -> Column:
    """none, low, medium or high after a repair, by whether the alert is gone, tests passed and, for vulnerabilities, a proof ran."""
    return F.when(gone & tests & (~vulnerability | proof), "none").when(gone, F.when(vulnerability, "medium").otherwise("low")).otherwise("high")


def reports(bound: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(alert_id, verdict, success, risk, recommendation) of repairs.

    outcomes: alert_id, gone, new_alerts, tests_passed, suppressed. New alerts or failing tests reject a repair whose alert is gone.
    """
    j = bound.join(outcomes, "alert_id")
    vulnerable = F.col("cwe").isNotNull() | F.col("rule_family").isin("injection", "nullderef")
    clean = F.col("gone") & (F.col("new_alerts") == 0)
    risk = remaining_risk(clean, F.col("tests_passed"), vulnerable, F.lit(False))
    verdict = F.when(F.col("suppressed"), "false_positive_suppressed").when(clean & F.col("tests_passed"), F.when(risk == "none", "alert_fixed").otherwise("alert_fixed_with_risk")).when(clean, "tests_failed").otherwise("alert_not_fixed")
    out = j.select("alert_id", verdict.alias("verdict"), risk.alias("risk"))
    return out.select("alert_id", "verdict", F.col("verdict").isin("alert_fixed", "alert_fixed_with_risk", "false_positive_suppressed").alias("success"), "risk", F.when(F.col("risk") != "none", "review-required").otherwise("merge-supporting").alias("recommendation"))


def run_resource(alerts: DataFrame, by: str) -> DataFrame:
    """One row a run: alert_count, rule_count, severities as sorted 'severity=n' and files; alerts without a file count under <unresolved>."""
    per = alerts.groupBy(by, "severity").agg(F.count("*").alias("n"))
    levels = per.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "severity", F.col("n").cast("string")))), ",").alias("severities"))
    sums = alerts.groupBy(by).agg(F.count("*").alias("alert_count"), F.count_distinct("rule_id").alias("rule_count"), F.count_distinct(F.coalesce("file_path", F.lit("<unresolved>"))).alias("files"))
    return sums.join(levels, by)


def ruleset(entries: list[str], texts: dict[str, str] | None = None, offline: bool = True) -> tuple[str, str]:
    """(id, name) of a ruleset: a hash of its entries, those that name a text by that text; packs of a registry need the network."""
    import hashlib
    import json

    out = []
    for e in entries or ["default"]:
        if texts and e in texts:
            out.append(texts[e])
        elif offline and e.startswith("p/"):
            raise ValueError(f"ruleset {e!r} is on a registry, which offline runs do not ask")
        else:
            out.append(e)
    return "ruleset:" + hashlib.sha256(json.dumps(out, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16], ",".join(entries or ["default"])

"""Metrics and gates (AGG-09..19, 26..35, 38..43, FUN-05/06/19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ece(samples: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """Expected calibration error by group over equal-width bins, the last one closed. No rows give 1.0 without by."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("predicted_probability") * bins))
    per = samples.groupBy(*by, b.alias("_bin")).agg(F.count("*").alias("n"), F.avg((F.col("predicted_label") == F.col("gold_label")).cast("double")).alias("acc"), F.avg("predicted_probability").alias("conf"))
    out = F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")
    return per.groupBy(*by).agg((out if by else F.coalesce(out, F.lit(1.0))).alias("ece"))


def label_scores(samples: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn and f1 of each label seen in gold or prediction; one explode, one aggregation."""
    two = samples.select(*by, "predicted_label", "gold_label", F.explode(F.array_distinct(F.array("predicted_label", "gold_label"))).alias("label"))
    p, g = F.col("predicted_label") == F.col("label"), F.col("gold_label") == F.col("label")
    c = two.groupBy(*by, "label").agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"))
    return c.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f1(samples: DataFrame, *by: str) -> DataFrame:
    """Mean f1 over labels; no rows give 0.0 without by."""
    out = F.avg("f1")
    return label_scores(samples, *by).groupBy(*by).agg((out if by else F.coalesce(out, F.lit(0.0))).alias("macro_f1"))


def calibration_report(samples: DataFrame, most_ece: float = 0.10, least_f1: float = 0.75) -> DataFrame:
    """One row: worst ece and f1 over families, and whether every family passes."""
    per = ece(samples, "family").join(macro_f1(samples, "family"), "family")
    ok = (F.col("ece") <= most_ece) & (F.col("macro_f1") >= least_f1)
    return per.agg(F.coalesce(F.max("ece"), F.lit(1.0)).alias("ece"), F.coalesce(F.min("macro_f1"), F.lit(0.0)).alias("macro_f1"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("passed"), F.coalesce(F.array_join(F.array_sort(F.collect_set("family")), "+"), F.lit("none")).alias("families"))


def binary_entropy(passed: Column, failed: Column) -> Column:
    n = passed + failed

    def part(k: Column) -> Column:
        p = k / n
        return F.when((k > 0) & (n > 0), -p * F.log2(p)).otherwise(0.0)

    return part(passed) + part(failed)


def flakiness(outcomes: DataFrame, threshold: float = 0.3) -> DataFrame:
    """instance_id, passed, failed, entropy, flaky. outcomes: instance_id, ok."""
    g = outcomes.groupBy("instance_id").agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))
    return g.withColumn("entropy", binary_entropy(F.col("passed"), F.col("failed"))).withColumn("flaky", F.col("entropy") > threshold)


def gold_coverage(ranked: Column, gold: Column, budget: int) -> tuple[Column, Column, Column]:
    """Whether all gold files are in the first 1, 3 and n of the ranked; budgets grow with the gold set; no gold: False."""
    g = F.array_distinct(gold)
    n = F.size(g)

    def inside(k: Column) -> Column:
        return (n > 0) & (F.size(F.array_except(g, F.slice(ranked, F.lit(1), k))) == 0)

    return inside(F.greatest(F.lit(1), n)), inside(F.greatest(F.lit(3), 3 * n)), inside(F.greatest(F.lit(budget), n))


def localisation_rates(results: DataFrame) -> DataFrame:
    """Rates over instances that are not flaky. results: flaky, gold_count, top1, top3, topn, repaired."""
    ok = results.where(~F.col("flaky"))

    def rate(c: Column) -> Column:
        return F.coalesce(F.avg(c.cast("double")), F.lit(0.0))

    near = F.col("top1") | F.col("top3")
    return ok.agg(F.count("*").alias("instances"), F.count_if(F.col("gold_count") <= 1).alias("single_file"), F.count_if(F.col("gold_count") > 1).alias("multi_file"), rate(F.col("top1")).alias("top1_rate"), rate(F.col("top3")).alias("top3_rate"), rate(F.col("topn")).alias("topn_rate"), F.coalesce(F.avg(F.when(near, F.col("repaired").cast("double"))), F.lit(0.0)).alias("conditioned_repair_rate"))


def operational_rates(runs: DataFrame, gates: dict[str, float]) -> DataFrame:
    """Mean of each boolean column named in gates, and the names that fall below their least value."""
    means = runs.agg(*(F.coalesce(F.avg(F.col(k).cast("double")), F.lit(0.0)).alias(k) for k in gates))
    bad = F.array_compact(F.array(*(F.when(F.col(k) < v, k) for k, v in gates.items())))
    return means.withColumn("failing", F.array_join(bad, ",")).withColumn("passed", F.size(bad) == 0)


def closure(incidents: DataFrame) -> DataFrame:
    """Share of P0 and P1 incidents that are closed (1.0 without any)."""
    hot = incidents.where(F.col("severity").isin("P0", "P1"))
    return hot.agg(F.coalesce(F.avg((F.col("state") == "closed").cast("double")), F.lit(1.0)).alias("closure_rate"), F.count("*").alias("incidents"))


def recall(predicted: Column, gold: Column) -> Column:
    """Share of gold in predicted, 1.0 without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.array_intersect(g, predicted)) / F.size(g))


def by_language(instances: DataFrame) -> DataFrame:
    """Resolve rate by language; an instance of several languages counts in each."""
    return instances.select(F.explode("languages").alias("language"), "resolved").groupBy("language").agg(F.count("*").alias("n"), F.avg(F.col("resolved").cast("double")).alias("resolve_rate"))


def verdict_status(satisfied: Column, violated: Column, unknown: Column) -> Column:
    return F.when(violated > 0, "non_compliant").when(unknown > 0, "incomplete").when(satisfied > 0, "compliant").otherwise("unknown")


def verdict_matrix(clauses: DataFrame, verdicts: DataFrame, by: str) -> DataFrame:
    """Counts of final verdicts (unknown where a clause has none) and the status by group."""
    j = clauses.join(verdicts.select("clause_id", "verdict"), "clause_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))
    g = j.groupBy(by).agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("satisfied", "violated", "unknown")))
    return g.withColumn("status", verdict_status(F.col("satisfied"), F.col("violated"), F.col("unknown")))


def aggregate_verdict(static: Column, confidence: Column, dynamic: Column, risk: Column, calibrated: Column, oracle: Column) -> Column:
    """struct(verdict, confidence, evidence, auto_pass) of a clause by precedence of its stages."""
    hard = confidence.isin("parser", "analyser", "compiler")
    soft_class = ~risk.isin("security", "compliance")

    def out(v: str, c, e: str, a) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(v).alias("verdict"), as_col(c).alias("confidence"), F.lit(e).alias("evidence"), as_col(a).alias("auto_pass"))

    return (
        F.when(static == "violated", out("violated", confidence, "static", False))
        .when(dynamic == "violated", out("violated", "analyser", "dynamic_trace", False))
        .when((static == "satisfied") & hard, out("satisfied", confidence, "static", calibrated & soft_class))
        .when(static == "satisfied", out("satisfied", "heuristic", "static", False))
        .when(calibrated & oracle & soft_class, out("satisfied", "heuristic", "calibrated_oracle", True))
        .otherwise(out("unknown", "unknown", "no_hard_evidence", False))
    )


def ece_bucket(p: Column) -> Column:
    return F.when(p >= 0.9, "high_confidence").when(p >= 0.7, "medium_confidence").otherwise("low_confidence")


def readiness(axes: list[Column], most: int = 20) -> Column:
    """Sum of axis points, each capped."""
    total = F.lit(0)
    for a in axes:
        total = total + F.least(F.greatest(a, F.lit(0)), F.lit(most))
    return total


def mixed_snapshots(rows: DataFrame, *by: str) -> DataFrame:
    """Whether a group mixes commits, or clean and dirty work. rows: snapshot_id, dirty."""
    g = rows.groupBy(*by).agg(F.count_distinct("snapshot_id").alias("snapshots"), F.count_if("dirty").alias("dirty"), F.count("*").alias("n"))
    mix = (F.col("snapshots") > 1) | ((F.col("dirty") > 0) & (F.col("dirty") < F.col("n")))
    return g.withColumn("status", F.when(mix, "mixed").when(F.col("dirty") > 0, "dirty").otherwise("clean"))


def ablation(full: DataFrame, ablated: DataFrame) -> DataFrame:
    """Severity of each ablation by the drop of its metric: critical from 0.1, moderate from 0.03, minor above 0."""
    j = full.select("metric", F.col("value").alias("base")).join(ablated.select("ablation", "metric", F.col("value").alias("left")), "metric")
    drop = F.col("base") - F.col("left")
    return j.select("ablation", "metric", F.round(drop, 6).alias("drop"), F.when(drop >= 0.1, "critical").when(drop >= 0.03, "moderate").when(drop > 0, "minor").otherwise("none").alias("impact"))


def roll_up(impacts: DataFrame) -> DataFrame:
    """The gravest impact of each ablation."""
    i = F.col("impact")
    return impacts.groupBy("ablation").agg(F.when(F.bool_or(i == "critical"), "critical").when(F.bool_or(i == "moderate"), "moderate").when(F.bool_or(i == "minor"), "minor").otherwise("none").alias("impact"))


def gate_roll_up(gates: DataFrame, by: str) -> DataFrame:
    """passed when all gates pass, with the failing names sorted."""
    return gates.groupBy(by).agg(F.bool_and("passed").alias("passed"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("gate")))), ",").alias("failing"))

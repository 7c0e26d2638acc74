"""Trajectory memory: write gates, retrieval, guard, relabelling, utility (RNK-19 to RNK-25, TOP-11, TOP-12).

records: trajectory_id, repo_id, source_run_id, retention_class, payload (text of the record), snippets (array), graph_snapshot_id, opted_in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import misaligned, word_overlap

SECRET = r"(?i)(?:password|secret|token|api_key|credential)\s*[:=]\s*\S+"
CLASSES = ("ephemeral", "workspace_local", "long_term", "archived")
FORBIDDEN = ("raw_prompt", "full_trace", "full_source", "command_output")
GATES = ("opt_in_check", "required_fields", "data_classification", "secret_scan", "snippet_type_check")


def write_gates(records: DataFrame, scan: bool = True) -> DataFrame:
    """(trajectory_id, failed, written, contradiction): the first of GATES that a record fails, null where it is written.

    A record without a graph snapshot is written with a contradiction.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    failed = F.when(~F.coalesce("opted_in", F.lit(False)), GATES[0]).when(blank("source_run_id") | blank("repo_id"), GATES[1]).when(~F.coalesce(F.col("retention_class").isin(*CLASSES), F.lit(False)), GATES[2]).when(F.lit(scan) & F.coalesce(F.col("payload").rlike(SECRET), F.lit(False)), GATES[3]).when(F.exists("snippets", lambda s: s.isin(*FORBIDDEN)), GATES[4])
    out = records.select("trajectory_id", failed.alias("failed"), "graph_snapshot_id")
    return out.select("trajectory_id", "failed", F.col("failed").isNull().alias("written"), (F.col("failed").isNull() & blank("graph_snapshot_id")).alias("contradiction"))


def hints(records: DataFrame, words: Column, of: str, by_similarity: bool, most: int = 5) -> DataFrame:
    """(trajectory_id, similarity, rejected, reason, place): place counts the active hints of an issue, null for rejected and those beyond most.

    records: trajectory_id, issue_id, expired, review_state, utility and the text column of, with which words (lower-cased, distinct) overlap.
    Fine hints go by similarity, coarse ones put high utility first; ties by trajectory_id.
    """
    own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(of), F.lit(""))), r"\s+"), lambda w: w != ""))
    scored = records.withColumn("similarity", word_overlap(words, own))
    reason = misaligned(F.col("expired"), F.col("review_state"), F.col("similarity"), F.col("utility"))
    scored = scored.select("issue_id", "trajectory_id", "similarity", "utility", reason.alias("reason"))
    order = [F.desc("similarity")] if by_similarity else [F.desc(F.coalesce(F.col("utility") == "high", F.lit(False)))]
    w = Window.partitionBy("issue_id", F.col("reason").isNull()).orderBy(*order, "trajectory_id")
    place = F.row_number().over(w)
    return scored.select("issue_id", "trajectory_id", "similarity", F.col("reason").isNotNull().alias("rejected"), "reason", F.when(F.col("reason").isNull() & (place <= most), place).alias("place"))


def relabelled(records: DataFrame, goal: Column) -> DataFrame:
    """New records from those that found no fix or any other outcome, for a goal met in hindsight: unreviewed, of medium utility; the old ones stay as they are."""
    return records.select(F.concat(F.lit("relabelled:"), F.substring(F.md5(F.concat_ws("|", F.col("trajectory_id").cast("string"), goal)), 1, 8)).alias("trajectory_id"), F.col("trajectory_id").alias("source_id"), F.when(F.col("outcome") == "no_fix_found", "resolved").otherwise(F.col("outcome")).alias("outcome"), F.lit("medium").alias("utility"), F.lit("unreviewed").alias("review_state"), goal.alias("goal"))

"""Retrieval and ranking (RNK, AGG-04..08, TOP)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import broadcast_up_to, materialise

STOP = ("the", "and", "or", "to", "in", "a", "of", "when", "is", "it", "on")
WEIGHTS: Mapping[str, float] = {"keyword": 0.25, "sarif": 0.2, "blame": 0.15, "graph_neighbour": 0.1, "sbfl": 0.2, "embedding": 0.1}


def tokens(text: Column) -> Column:
    """Identifiers of two characters and more, lower-cased, a final ing cut."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_]+)"), F.lit(1))
    return F.transform(raw, lambda t: F.regexp_replace(F.lower(t), "ing$", ""))


def query_terms(text: str) -> list[str]:
    """What tokens makes of a query, without stop words."""
    return sorted({re.sub("ing$", "", t.lower()) for t in re.findall("[A-Za-z_][A-Za-z0-9_]+", text)} - set(STOP))


def keyword_scores(corpus: DataFrame, query: str) -> DataFrame:
    """(id, score): sum of tf * ln((N + 1) / (df + 1) + 1) over the query's terms; corpus: id, text.

    Terms are literals, so a text's tokens are made once; only those that are terms leave it, and the shuffle holds hits and not the corpus.
    """
    terms = query_terms(query)
    words = corpus.select("id", F.explode(tokens(F.col("text"))).alias("term"))
    hits = words.where(F.col("term").isin(terms)).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = corpus.agg(F.count("*").alias("n"))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))
    return scored.groupBy("id").agg(F.sum(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1) + 1)).alias("score"))


def max_normalised(df: DataFrame, score: str = "score", *by: str) -> DataFrame:
    """score over the greatest, of each group or of all; the greatest of all comes by an aggregate, as one window would be one task."""
    if by:
        top = F.max(score).over(Window.partitionBy(*by))
        return df.withColumn(score, F.least(F.col(score) / top, F.lit(1.0)))
    top = df.agg(F.max(score).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(score, F.least(F.col(score) / F.col("_top"), F.lit(1.0))).drop("_top")


def best_per(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def first_per(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def keyword_candidates(nodes: DataFrame, text: str, files: list[str], symbols: list[str]) -> DataFrame:
    """(repo_id, file_path, node_id, score) of files: keyword scores of nodes, +2.0 for a named file and +1.5 for a named symbol.

    Files and symbols are searched as text too. All nodes count in N and df, those without a file are no candidates;
    of a file the best node stays (at a tie the least node_id), and scores are divided by the greatest.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("label", "qualified_name", "file_path", "properties") if c in nodes.columns]
    found = keyword_scores(nodes.select(F.col("node_id").alias("id"), F.concat_ws(" ", *parts).alias("text")), " ".join([*files, *symbols, text]))
    name = F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("label"))
    bonus = F.when(F.col("file_path").isin(files), 2.0).otherwise(0.0) + F.when(name.isin(symbols), 1.5).otherwise(0.0)
    scored = nodes.where("file_path <> ''").join(found, nodes.node_id == found.id, "left").select("repo_id", "file_path", "node_id", (F.coalesce("score", F.lit(0.0)) + bonus).alias("score"))
    return max_normalised(best_per(scored.where("score > 0"), ["repo_id", "file_path"], [F.desc(F.round("score", 9)), F.asc("node_id")]))


def weight_of(kind: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[kind], F.lit(0.0))


def merge_signals(signals: DataFrame, least: float = 0.05, most: int | None = None) -> DataFrame:
    """Ranked files: all signals weigh in the sum, each type once in the divisor, capped at 1."""
    w = weight_of(F.col("signal_type"))
    by_type = signals.groupBy("repo_id", "file_path", "signal_type").agg(F.sum(F.col("raw_score") * w).alias("s"), F.first(w).alias("w"), F.bool_or(F.col("raw_score") > 0.3).alias("strong"), F.bool_or("is_generated").alias("is_generated"))
    g = by_type.groupBy("repo_id", "file_path").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.count("*").alias("types"), F.count_if(F.col("w") > 0).alias("available"), F.count_if("strong").alias("agreeing"), F.bool_or("is_generated").alias("is_generated"))
    out = g.select("repo_id", "file_path", "is_generated", "types", F.least(F.col("s") / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0), F.lit(1.0)).alias("score"), F.when(F.col("available") > 0, F.col("agreeing") / F.col("available")).otherwise(0.0).alias("agreement"))
    out = out.where(F.col("score") >= least).withColumn("confidence", F.when(F.col("agreement") >= 0.6, "analyser").otherwise("heuristic"))
    return out.orderBy("is_generated", F.desc("types"), F.desc("score"), "repo_id", "file_path").limit(most) if most else out


def sarif_prior(alerts: DataFrame, symbols: list[str], errors: list[str], has_cwe: bool, security: bool) -> DataFrame:
    """Share of severity times match by file, the greatest 1. alerts: file_path, severity, message, rule_id, suppressed."""
    base = F.when(F.col("severity") == "critical", 1.0).when(F.col("severity") == "high", 0.8).when(F.col("severity") == "medium", 0.5).when(F.col("severity") == "low", 0.2).otherwise(0.1)
    hay = F.lower(F.concat_ws(" ", "message", "rule_id"))

    def any_in(words: list[str]) -> Column:
        c = F.lit(False)
        for x in words:
            c = c | hay.contains(x.lower())
        return c

    match = F.when(any_in(errors), 1.0).when(any_in(symbols), 0.9).when(F.lit(has_cwe), 0.7).when(F.lit(security) & F.col("severity").isin("critical", "high"), 0.3).otherwise(0.0)
    s = alerts.where(~F.col("suppressed") & F.col("file_path").isNotNull()).select("file_path", (base * match).alias("score")).where("score > 0").groupBy("file_path").agg(F.sum("score").alias("score"))
    return max_normalised(s)


def recency(ts: Column, as_of: Column) -> Column:
    """exp(-hours / 168), future times count as now, null as 0."""
    hours = F.greatest((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 3600, F.lit(0.0))
    return F.when(ts.isNotNull(), F.exp(-hours / 168)).otherwise(0.0)


def blame_prior(entries: DataFrame, terms: list[str], as_of: Column) -> DataFrame:
    """Best of 0.4 recency + 0.4 match + 0.2 churn by file; files of one entry need a match. entries: file_path, author_ts, summary."""
    churn = entries.groupBy("file_path").agg(F.count("*").alias("churn"))
    top = churn.agg(F.max("churn").alias("top"))
    low = F.lower("summary")
    match = F.lit(False)
    for t in terms:
        match = match | low.contains(t.lower())
    e = entries.withColumn("hit", F.coalesce(match, F.lit(False))).join(churn, "file_path").crossJoin(F.broadcast(top)).where("hit or churn > 1")
    score = 0.4 * recency(F.col("author_ts"), as_of) + F.when(F.col("hit"), 0.4).otherwise(0.0) + 0.2 * F.least(F.col("churn") / F.col("top"), F.lit(1.0))
    return e.groupBy("file_path").agg(F.least(F.max(score), F.lit(1.0)).alias("score"))


def ochiai(ef: Column, ep: Column, nf: Column, np: Column) -> Column:
    """Suspiciousness of a line from failing and passing runs that hit or miss it; 0 where undefined."""
    d = F.sqrt((ef + nf) * (ef + ep))
    return F.when(d > 0, ef / d).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors; the longer vector is cut."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(d > 0, dot(x, y) / d).otherwise(0.0)


def top_k(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity, rank) of the k nearest by cosine. Queries are broadcast if their counted size allows; each
    partition keeps its k best of a query before the shuffle."""
    wide = queries.select(F.max(F.size("query"))).first()[0] or 1
    pairs = corpus.crossJoin(broadcast_up_to(queries, 32 + 8 * wide)).select("query_id", "id", cosine(F.col("query"), F.col("vector")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tiered(df: DataFrame, tiers: list[Column], by: list[str] | None = None) -> DataFrame:
    """Rows of the first tier, of those given, that has any; tier counts from 1."""
    t = F.lit(None).cast("int")
    for i, c in reversed(list(enumerate(tiers, 1))):
        t = F.when(c, F.lit(i)).otherwise(t)
    rows = df.withColumn("tier", t).where("tier is not null")
    if by:
        # The first tiers of groups travel to the rows, so no group meets in one task.
        least = rows.groupBy(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by))).agg(F.min("tier").alias("_m"))
        least = broadcast_up_to(materialise(least, "tiers"), 128 * len(by))
        same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
        return rows.join(least, [*same, F.col("tier") == F.col("_m")]).drop("_m", *(f"_by{i}" for i in range(len(by))))
    return rows.crossJoin(F.broadcast(rows.agg(F.min("tier").alias("_m")))).where("tier = _m").drop("_m")


def word_overlap(words: Column, of: Column) -> Column:
    """Share of the distinct words of `of` that are in words; 0 for none."""
    own = F.array_distinct(of)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, words)) / F.size(own)).otherwise(0.0)


def misaligned(expired: Column, review_state: Column, similarity: Column, utility: Column) -> Column:
    """Reason to hold a memory back, null for none."""
    return F.when(expired, "expired").when(review_state == "unreviewed", "unreviewed").when(review_state == "superseded", "superseded").when((similarity >= 0.85) & (utility == "low"), "high_similarity_low_utility")


def utility_score(utility: Column, outcome: Column, relabelled: Column, penalty: float = 0.2) -> Column:
    base = F.when(utility == "high", 1.0).when(utility == "medium", 0.5).when(utility == "low", 0.1).otherwise(0.3)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(outcome.isin("resolved", "resolved_with_risk"), 0.2).otherwise(0.0) - F.when(relabelled, penalty).otherwise(0.0)))

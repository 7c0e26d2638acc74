"""Answers and investigations composed of lookups, traversal and gates (RNK-09 to RNK-12, RNK-16 to RNK-18, GRF-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.gates import question_class
from lodestone.operators.graph import expand_files
from lodestone.operators.ranking import first_per, keyword_candidates, merge_signals, weight_of


def code_tokens(text: Column) -> Column:
    """What a question puts between backticks, in order."""
    return F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), F.lit(1))


def intents(questions: DataFrame) -> DataFrame:
    """questions (question_id, repo_id, text) with class, start and target symbol, and cross_language."""
    low, tokens = F.lower("text"), code_tokens(F.col("text"))
    crossing = low.contains("cross-language") | low.contains("http") | low.contains("idl")
    return questions.select("question_id", "repo_id", question_class(F.col("text"))["best"].alias("class"), F.get(tokens, F.lit(0)).alias("start_symbol"), F.get(tokens, F.lit(1)).alias("target_symbol"), crossing.alias("cross_language"), F.array_distinct(tokens).alias("tokens"))


def _least(keyed: DataFrame, most: int) -> DataFrame:
    """(repo_id, key, ids): the most least distinct node_ids of each key of keyed (repo_id, key, node_id)."""
    k = F.dense_rank().over(Window.partitionBy("repo_id", "key").orderBy("node_id"))
    return keyed.withColumn("_k", k).where(F.col("_k") <= most).groupBy("repo_id", "key").agg(F.collect_set("node_id").alias("ids"))


def evidence(asked: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """(question_id, node_id, confidence): nodes of the question's repository that its tokens name.

    A file question asks for paths that end in a token, every other one for a label or qualified name.
    Those are parser-grade; a label equal but for case and marks is heuristic and counts only where nothing
    is exact. most by confidence, then node_id.

    No question takes more than most nodes of a token, so each distinct token is looked up once and has its least most nodes
    before it meets the questions that name it.
    """
    t = asked.select("question_id", "repo_id", (F.col("class") == "file_location").alias("file"), F.explode("tokens").alias("token"))
    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    base = lambda c: F.substring_index(c, "/", -1)
    t = t.withColumn("s", F.when(~F.col("file"), F.nullif(squash(F.col("token")), F.lit(""))))
    own = lambda key, file: t.where("file" if file else "not file").select("repo_id", F.col(key).alias("key")).where("key is not null").distinct()
    n = nodes.select("node_id", "repo_id", "label", "qualified_name", "file_path")
    # A path ends in a token, and has its last part, where the token is one of the suffixes that hold that part.
    paths = _least(n.where("file_path is not null").select("repo_id", F.col("file_path").alias("key"), "node_id"), most)
    ends = F.sequence(F.lit(1), F.length("path") - F.length(base("path")) + 1)
    suffixes = paths.select("repo_id", F.col("key").alias("path"), "ids").select("repo_id", F.explode(F.transform(ends, lambda i: F.substring("path", i, F.length("path")))).alias("key"), "ids")
    files = _least(suffixes.join(own("token", True), ["repo_id", "key"], "left_semi").select("repo_id", "key", F.explode("ids").alias("node_id")), most)
    names = n.select("repo_id", F.explode(F.array_distinct(F.array_compact(F.array("label", "qualified_name")))).alias("key"), "node_id")
    exact = _least(names.join(own("token", False), ["repo_id", "key"], "left_semi"), most)
    fuzzy = _least(n.select("repo_id", squash(F.col("label")).alias("key"), "node_id").join(own("s", False), ["repo_id", "key"], "left_semi"), most)
    sure = files.withColumn("file", F.lit(True)).unionByName(exact.withColumn("file", F.lit(False)))
    found = t.join(sure.select("repo_id", F.col("key").alias("token"), "file", F.col("ids").alias("sure")), ["repo_id", "file", "token"], "left")
    found = found.join(fuzzy.select("repo_id", F.col("key").alias("s"), F.col("ids").alias("near")), ["repo_id", "s"], "left")
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, most)
    g = found.groupBy("question_id").agg(least("sure").alias("sure"), least("near").alias("near"))
    parser = F.size("sure") > 0
    return g.select("question_id", F.explode(F.when(parser, F.col("sure")).otherwise(F.col("near"))).alias("node_id"), F.when(parser, "parser").otherwise("heuristic").alias("confidence"))


def traces(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, path, confidence, diagnostic) of behaviour traces: from the node of the start symbol, capped at heuristic.

    Without a start symbol, or a node for it, there is no path and confidence is unknown.
    """
    first = found.groupBy("question_id").agg(F.min(F.struct(F.when(F.col("confidence") == "parser", 0).otherwise(1).alias("o"), "node_id")).alias("x"))
    j = asked.where("class = 'behaviour_trace'").join(first, "question_id", "left")
    diagnostic = F.when(F.col("start_symbol").isNull(), "NO_START_SYMBOL").when(F.col("x").isNull(), "NO_START_NODE")
    return j.select("question_id", F.when(diagnostic.isNull(), F.array("x.node_id")).alias("path"), F.when(diagnostic.isNull(), "heuristic").otherwise("unknown").alias("confidence"), diagnostic.alias("diagnostic"))


def answers(questions: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """(question_id, class, n_evidence, nodes, confidence, action) of every question.

    File and symbol questions are as sure as their best evidence; traces and all others are heuristic; no evidence is unknown
    and recommends an action. nodes are the evidence's ids, sorted.
    """
    asked = intents(questions)
    found = evidence(asked, nodes, most)
    g = found.groupBy("question_id").agg(F.count("*").alias("n"), F.bool_or(F.col("confidence") == "parser").alias("sure"), F.array_sort(F.collect_list("node_id")).alias("nodes"))
    j = asked.join(g, "question_id", "left")
    n = F.coalesce("n", F.lit(0))
    trace = F.col("class") == "behaviour_trace"
    confidence = F.when((n == 0) | (trace & F.col("start_symbol").isNull()), "unknown").when(F.col("class").isin("file_location", "symbol_location"), F.when(F.col("sure"), "parser").otherwise("heuristic")).otherwise("heuristic")
    action = F.when(confidence == "unknown", F.when(trace, "name a start symbol").when(F.col("class") == "file_location", "name a file").otherwise("name a symbol"))
    return j.select("question_id", "class", n.alias("n_evidence"), F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"), confidence.alias("confidence"), action.alias("action"))


def contracts(records: DataFrame, operation: str | None = None, plugin: str | None = None) -> DataFrame:
    """(interface_id, plugin_id, operation) of interface records whose operations (array) hold what is asked, all without it; without case."""
    r = records.where(F.col("plugin_id") == plugin) if plugin else records
    ops = r.select("interface_id", "plugin_id", F.explode("operations").alias("operation"))
    return ops.where(F.lower("operation").contains(operation.lower())) if operation else ops


def signals_of(nodes: DataFrame, edges: DataFrame, text: str, files: list[str], symbols: list[str], hops: int = 2) -> DataFrame:
    """(repo_id, file_path, signal_type, raw_score, is_generated): keyword candidates and the files near them."""
    keyword = keyword_candidates(nodes, text, files, symbols).select("repo_id", "file_path", "score")
    near = expand_files(nodes, edges, keyword, hops).select("repo_id", "file_path", "score")
    both = keyword.withColumn("signal_type", F.lit("keyword")).unionByName(near.withColumn("signal_type", F.lit("graph_neighbour")))
    return both.select("repo_id", "file_path", "signal_type", F.col("score").alias("raw_score"), F.col("file_path").rlike("(?i)generated|_pb2").alias("is_generated"))


def localise(nodes: DataFrame, edges: DataFrame, text: str, files: list[str], symbols: list[str], most: int = 8) -> DataFrame:
    """The most suspect files of an issue: keyword candidates, graph expansion, merged signals, the first most."""
    return merge_signals(signals_of(nodes, edges, text, files, symbols), most=most)


def uncertainty(agreement: Column, embedding: Column, stale: Column, files: Column, unresolved: Column) -> Column:
    """struct(confidence cap, notes): heuristic for low agreement, a stale graph or no frame resolved, and a note for each shortcoming."""
    low = agreement < 0.3
    notes = F.array_compact(F.array(F.when(low, "low agreement"), F.when(~embedding, "no embedding"), F.when(stale, "stale graph"), F.when(files > 10, "over budget"), F.when(unresolved, "frames unresolved")))
    return F.struct(F.when(low | stale | unresolved, "heuristic").alias("cap"), notes.alias("notes"))


def investigate(signals: DataFrame, most: int = 8) -> DataFrame:
    """(file_path, place, chain): ranked files, each with its signals as 'type=score', the weightiest first."""
    ranked = merge_signals(signals, most=most)
    ranked = ranked.withColumn("place", F.row_number().over(Window.orderBy("is_generated", F.desc("types"), F.desc("score"), "repo_id", "file_path")))
    by = signals.groupBy("repo_id", "file_path", "signal_type").agg(F.max("raw_score").alias("best"))
    step = F.struct((-weight_of(F.col("signal_type"))).alias("w"), F.col("signal_type").alias("t"), F.concat(F.col("signal_type"), F.lit("="), F.format_string("%.3f", F.col("best"))).alias("x"))
    chains = by.groupBy("repo_id", "file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["x"]), "; ").alias("chain"))
    return ranked.join(chains, ["repo_id", "file_path"]).select("repo_id", "file_path", "place", "chain")


def context(ranked: DataFrame, nodes: DataFrame, budget: int = 10, per_file: int = 5) -> DataFrame:
    """(repo_id, file_path, place, symbols, beyond): the context bundle of ranked files (place), per_file symbols each by line, beyond telling those past the budget."""
    n = nodes.where("file_path is not null").select("repo_id", "file_path", "node_id", "start_line")
    some = first_per(ranked.select("repo_id", "file_path", "place").join(n, ["repo_id", "file_path"]), ["repo_id", "file_path"], [F.asc("start_line"), F.asc("node_id")], per_file)
    own = some.groupBy("repo_id", "file_path").agg(F.array_sort(F.collect_list("node_id")).alias("symbols"))
    return ranked.select("repo_id", "file_path", "place").join(own, ["repo_id", "file_path"], "left").select("repo_id", "file_path", "place", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), (F.col("place") > budget).alias("beyond"))

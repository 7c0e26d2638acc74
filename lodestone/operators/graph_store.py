"""Selection, counting and writing of graph rows (FLT, AGG-01/02, JON-02/03, IDX-14..16, SET)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import broadcast_up_to, materialise, numbered

_PLACES = {"repo", "repository", "package", "directory", "file", "module"}
_SYMBOLS = {"class", "function", "method", "variable", "type"}
_INTERFACES = {"interface", "idl_interface", "http_route", "websocket_event", "grpc_service", "protobuf_message"}
_IMPORTING = {"file", "module", "package"}
_CALLING = {"function", "method"}
_CHANGES = {"patch", "diff_hunk"}

#: Which node types an edge type may join, as a set of allowed types or, with "not", of forbidden ones; other edge types are unchecked.
ENDPOINTS: dict[str, tuple[set[str], set[str]]] = {
    "contains": (_PLACES | _SYMBOLS, {"not", "repo", "repository"}),
    "imports": (_IMPORTING, _IMPORTING),
    "calls": (_CALLING, _CALLING),
    "tests": ({"test", "generated_test"}, _SYMBOLS | _INTERFACES),
    "warned_by": (_SYMBOLS | _INTERFACES | {"file"}, {"sarif_alert", "sast_rule"}),
    "changed_by": ({"not", *_CHANGES}, _CHANGES),
    "triggered_incident": ({"monitor_alert", "run_event"}, {"incident"}),
}


def point(df: DataFrame, key: str, value) -> DataFrame:
    """At most one row of that key."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def by_type(df: DataFrame, column: str, value: str, repo: str, snapshot: str | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of a repository and type, of one snapshot if given; order makes a limit deterministic."""
    out = df.where((F.col("repo_id") == repo) & (F.col(column) == value))
    if snapshot is not None:
        out = out.where(F.col("snapshot_id") == snapshot)
    return out.orderBy(order or df.columns[0]).limit(limit) if limit is not None else out


def of_file(nodes: DataFrame, repo: str, path: str, limit: int) -> DataFrame:
    """Nodes of a file, the first limit by id, with truncated telling whether there were more."""
    some = nodes.where((F.col("repo_id") == repo) & (F.col("file_path") == path)).orderBy("node_id").limit(limit + 1)
    n = Window.partitionBy()
    ranked = some.withColumn("_n", F.count("*").over(n)).withColumn("_k", F.row_number().over(n.orderBy("node_id")))
    return ranked.where(F.col("_k") <= limit).withColumn("truncated", F.col("_n") > limit).drop("_n", "_k")


def in_span(nodes: DataFrame, repo: str, path: str, start: int, end: int) -> DataFrame:
    """Nodes that a line span contains whole."""
    return nodes.where((F.col("repo_id") == repo) & (F.col("file_path") == path) & (F.col("start_line") >= start) & (F.col("end_line") <= end))


def consistency(nodes: DataFrame, *by: str) -> DataFrame:
    """clean where a group has one snapshot at most, else mixed."""
    return nodes.groupBy(*by).agg(F.count_distinct("snapshot_id").alias("snapshots")).withColumn("consistency", F.when(F.col("snapshots") <= 1, "clean").otherwise("mixed"))


def symbol(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where((F.col("node_id") == name) | (F.col("qualified_name") == name) | (F.col("label") == name))


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("repo_id", column).agg(F.count("*").alias("n"))


def endpoint_violations(edges: DataFrame, nodes: DataFrame, matrix: dict = ENDPOINTS) -> DataFrame:
    """Edges whose known endpoints have types the matrix forbids. Types travel with two narrow joins."""
    kind = nodes.select("node_id", "node_type")
    both = edges.where(F.col("edge_type").isin(*matrix)).join(kind.select(F.col("node_id").alias("source_id"), F.col("node_type").alias("source_type")), "source_id").join(kind.select(F.col("node_id").alias("target_id"), F.col("node_type").alias("target_type")), "target_id")

    def fits(column: str, types: set[str]) -> Column:
        hit = F.col(column).isin(*(types - {"not"}))
        return ~hit if "not" in types else hit

    ok: Column = F.lit(False)
    for t, (src, dst) in matrix.items():
        ok = ok | ((F.col("edge_type") == t) & fits("source_type", src) & fits("target_type", dst))
    return both.where(~ok)


def _absent(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id): the endpoints that no node has, each once. These are few as a rule and travel to the edges, which are then not shuffled."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct()
    return broadcast_up_to(materialise(ends.join(nodes.select(F.col("node_id").alias("id")), "id", "left_anti"), "absent"), 64)


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that no node has, one for each id; missing names it, the source where both are."""
    absent = _absent(edges, nodes)
    both = edges.drop("missing")
    for c in ("source_id", "target_id"):
        both = both.join(absent.select(F.col("id").alias(f"_{c}")), F.col(c) == F.col(f"_{c}"), "left")
    lost = {c: F.col(c).isNull() | F.col(f"_{c}").isNotNull() for c in ("source_id", "target_id")}
    missing = F.when(lost["source_id"], "source_id").when(lost["target_id"], "target_id")
    return both.withColumn("missing", missing).where("missing is not null").drop("_source_id", "_target_id").dropDuplicates(["edge_id"])


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("source_id") == F.col("target_id"))


def insert_edges(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges whose two endpoints exist, one for each id."""
    out = new.where("source_id is not null and target_id is not null")
    # Either the nodes are few, or those that are absent as a rule.
    known = nodes.select(F.col("node_id").alias("id"))
    few = broadcast_up_to(known, 64)
    ids, how = (few, "left_semi") if few is not known else (_absent(new, nodes), "left_anti")
    return out.join(ids, F.col("source_id") == F.col("id"), how).join(ids, F.col("target_id") == F.col("id"), how).dropDuplicates(["edge_id"])


def insert_absent(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not there yet; of equal keys in new the first by all columns."""
    w = Window.partitionBy(key).orderBy(*([c for c in new.columns if c != key] or [key]))
    return new.join(have.select(key), key, "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(have: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows, of equal keys the latest by order, of equal order the one from new."""
    both = have.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def merge_facts(facts: DataFrame) -> DataFrame:
    """Facts of several backends under one key: strongest evidence, then confidence, then backend order.

    facts: key, backend, backend_order, strength, confidence, start_line, end_line. Losers'
    backends are listed in merged_backends, spans unlike the winner's counted.
    """
    w = Window.partitionBy("key").orderBy(F.desc("strength"), F.desc("confidence"), "backend_order")
    ranked = facts.withColumn("_k", F.row_number().over(w)).withColumn("_s", F.first("start_line").over(w)).withColumn("_e", F.first("end_line").over(w))
    lost = F.col("_k") > 1
    return ranked.groupBy("key").agg(
        F.max_by("backend", -F.col("_k")).alias("backend"),
        F.max_by("confidence", -F.col("_k")).alias("confidence"),
        F.array_sort(F.collect_set(F.when(lost, F.col("backend")))).alias("merged_backends"),
        F.count_if(lost & ((F.col("start_line") != F.col("_s")) | (F.col("end_line") != F.col("_e")))).alias("span_conflicts"),
    )


def first_edges(edges: DataFrame, arrival: str) -> DataFrame:
    """The first arrival of each (type, source, target)."""
    w = Window.partitionBy("edge_type", "source_id", "target_id").orderBy(arrival)
    return edges.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def reconcile_nodes(facts: DataFrame) -> DataFrame:
    """A node is confirmed when more than one backend reports it."""
    return facts.groupBy("key").agg(F.array_sort(F.collect_set("backend")).alias("backends")).withColumn("agreement", F.when(F.size("backends") > 1, "confirmed").otherwise("single"))


def reconcile_edges(edges: DataFrame) -> DataFrame:
    """By (type, source): several targets conflict and share the least confidence, else the best edge stays."""
    g = Window.partitionBy("edge_type", "source_id")
    e = edges.withColumn("_lo", F.min("target_id").over(g)).withColumn("_hi", F.max("target_id").over(g)).withColumn("_least", F.min("confidence").over(g))
    best = Window.partitionBy("edge_type", "source_id").orderBy(F.desc("confidence"), "edge_id")
    conflict = F.col("_lo") != F.col("_hi")
    return e.withColumn("_k", F.row_number().over(best)).where(conflict | (F.col("_k") == 1)).select("edge_id", "edge_type", "source_id", "target_id", F.when(conflict, "conflicting").otherwise("agreed").alias("status"), F.when(conflict, F.col("_least")).otherwise(F.col("confidence")).alias("confidence"))


def chunk_by_module(nodes: DataFrame, most: int = 2000) -> DataFrame:
    """(repo_id, chunk, node_id): whole modules are packed greedily, in order, into chunks of most nodes.

    A module is the folder of a file. Modules above most are cut into pieces of that size. Only
    one row a piece is packed in Python; node rows follow by a join.
    """
    folder = F.coalesce(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1), F.lit(""))
    own = numbered(nodes.select("repo_id", folder.alias("module"), "node_id"), "module", ["repo_id", "module"], ["node_id"], "_k")
    own = own.select("repo_id", "module", "node_id", F.floor(F.col("_k") / most).alias("piece"))
    sizes = own.groupBy("repo_id", "module", "piece").agg(F.count("*").alias("n"))

    def pack(pdf):
        pdf = pdf.sort_values(["module", "piece"])
        chunk, held, out = 0, 0, []
        for n in pdf["n"]:
            if held and held + n > most:
                chunk, held = chunk + 1, 0
            held += n
            out.append(chunk)
        return pdf.assign(chunk=out)[["repo_id", "module", "piece", "chunk"]]

    packed = sizes.groupBy("repo_id").applyInPandas(pack, "repo_id string, module string, piece long, chunk long")
    packed = broadcast_up_to(materialise(packed, "packed"), 192)
    return own.join(packed, ["repo_id", "module", "piece"]).select("repo_id", "chunk", "node_id")

"""Traversal over edge tables by frontier joins (GRF). Frontiers are written out each hop, so lineage stays short."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import broadcast_up_to, materialise


def neighbours(edges: DataFrame, node: str, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(edge_id, edge_type, neighbour, way) of one node, itself left out."""
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    out = e.where((F.col("source_id") == node) & (F.col("target_id") != node)).select("edge_id", "edge_type", F.col("target_id").alias("neighbour"), F.lit("out").alias("way"))
    into = e.where((F.col("target_id") == node) & (F.col("source_id") != node)).select("edge_id", "edge_type", F.col("source_id").alias("neighbour"), F.lit("in").alias("way"))
    return {"out": out, "in": into}.get(direction) or out.unionByName(into)


def ego(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """(node_id, hop) within depth undirected hops of seeds (node_id), the least hop each."""
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    links = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = materialise(seeds.select("node_id").distinct().withColumn("hop", F.lit(0)), "ego")
    frontier = seen
    for hop in range(1, depth + 1):
        step = links.join(frontier.select(F.col("node_id").alias("a")), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
        frontier = materialise(step.join(seen, "node_id", "left_anti").withColumn("hop", F.lit(hop)), "ego")
        seen = seen.unionByName(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are in nodes (node_id)."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids, F.col("source_id") == F.col("node_id"), "left_semi").join(ids, F.col("target_id") == F.col("node_id"), "left_semi")


def callers(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    """Callers of a node and what lies within depth hops of them: depth 1 reaches two hops."""
    first = edges.where((F.col("edge_type") == "calls") & (F.col("target_id") == node)).select(F.col("source_id").alias("node_id"))
    return ego(edges, first, depth, ["calls"])


def callees(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    first = edges.where((F.col("edge_type") == "calls") & (F.col("source_id") == node)).select(F.col("target_id").alias("node_id"))
    return ego(edges, first, depth, ["calls"])


def with_one_hop(nodes: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """nodes (node_id) and all one hop away over edges of types, each once."""
    e = edges.where(F.col("edge_type").isin(*types))
    ids = nodes.select("node_id")
    a = e.join(ids, F.col("source_id") == F.col("node_id"), "left_semi").select(F.col("target_id").alias("node_id"))
    b = e.join(ids, F.col("target_id") == F.col("node_id"), "left_semi").select(F.col("source_id").alias("node_id"))
    return ids.unionByName(a).unionByName(b).distinct()


def impact_group(node_type: Column, edge_type: Column, hop: Column) -> Column:
    """Group of an impacted node; callers beyond one hop are downstream behaviour."""
    base = F.when((node_type == "test") | (edge_type == "tests"), "tests").when((node_type == "interface") | edge_type.isin("exposes", "consumes"), "interfaces").when((node_type == "sarif_alert") | (edge_type == "warns_by"), "sarif_alerts").when((node_type == "spec") | (edge_type == "satisfies"), "specs").when(node_type == "document", "documents").otherwise("direct_callers")
    return F.when((base == "direct_callers") & (hop > 1), "downstream_behaviours").otherwise(base)


POLICIES: Mapping[str, tuple[int, tuple[str, ...]]] = {
    "internal_implementation": (3, ("calls", "imports", "tests")),
    "public_api_change": (5, ("calls", "imports", "tests", "exposes", "consumes")),
    "idl_schema_contract_change": (6, ()),
    "security_sensitive_change": (4, ()),
    "generated_file_change": (2, ("calls", "imports", "tests")),
    "mixed": (6, ()),
    "unknown": (3, ("calls", "imports", "tests")),
}


def blast_radius(edges: DataFrame, nodes: DataFrame, starts: list[str], change: str = "unknown", threshold: float = 0.7, start_order: str = "level") -> tuple[DataFrame, DataFrame]:
    """(confirmed, ambiguous) by directed search along confident edges of the policy.

    level: all starts advance together and a node has its least hop; of several parents the one on
    the least path stands. sequential: each start ends before the next, sharing what was visited,
    as order-dependent callers expect. Ambiguous links leave a visited node and are not followed.
    """
    hops, types = POLICIES.get(change, POLICIES["unknown"])
    spark = edges.sparkSession
    e = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("to"), "edge_type", "confidence")
    sure = e.where((F.col("confidence") >= threshold) & (F.col("edge_type").isin(*types) if types else F.lit(True)))
    weak = e.where(F.col("confidence") < threshold)
    schema = "node_id string, hop int, path array<string>, edge_types array<string>, confidence double, edge_type string"
    visited = spark.createDataFrame([(s,) for s in starts], "node_id string")
    found = spark.createDataFrame([], schema)
    doubt = spark.createDataFrame([], "source_id string, target_id string, edge_type string, confidence double")
    rounds = [[s] for s in starts] if start_order == "sequential" else [starts]
    for group in rounds:
        frontier = spark.createDataFrame([(s, 0, [], [], 1.0, "") for s in group], schema)
        for hop in range(1, hops + 1):
            # A frontier that is small travels to the edges, which then need no shuffle.
            lead = broadcast_up_to(frontier.select(F.col("node_id").alias("at"), F.col("path").alias("p"), F.col("edge_types").alias("t")), 256 * (hop + 1))
            near = broadcast_up_to(visited.withColumnRenamed("node_id", "to"), 64)
            more = weak.join(lead.select("at"), "at").join(near, "to", "left_anti").select(F.col("at").alias("source_id"), F.col("to").alias("target_id"), "edge_type", "confidence")
            doubt = doubt.unionByName(more)
            step = sure.join(lead, "at").join(near, "to", "left_anti")
            step = step.select(F.col("to").alias("node_id"), F.lit(hop).alias("hop"), F.concat("p", F.array("at")).alias("path"), F.concat("t", F.array("edge_type")).alias("edge_types"), "confidence", "edge_type")
            w = Window.partitionBy("node_id").orderBy("path", F.desc("confidence"), "edge_type")
            frontier = materialise(step.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"), "blast")
            if frontier.isEmpty():
                break
            found = found.unionByName(frontier)
            visited = visited.unionByName(frontier.select("node_id"))
    ids = broadcast_up_to(found.select("node_id").distinct(), 64)
    kinds = nodes.select("node_id", "node_type").join(ids, "node_id", "left_semi")
    confirmed = found.join(kinds, "node_id", "left").select("node_id", F.coalesce("node_type", F.lit("symbol")).alias("node_type"), "hop", "path", "edge_types", F.when(F.col("confidence") >= 0.9, "analyser").otherwise("heuristic").alias("grade"), impact_group(F.coalesce("node_type", F.lit("symbol")), F.col("edge_type"), F.col("hop")).alias("impact_group"))
    return confirmed, doubt


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int) -> DataFrame:
    """The least undirected path, (hops, nodes, edges) with the ids of both; no row if there is none within max_hops.

    Of paths as short the least by nodes, then by edges.

    The search goes from both ends, each time from the one with fewer nodes at its rim, and keeps the links of each level.
    Where the rims meet, the levels are cut to links of least paths from there outward, and only those get paths.
    """
    spark = edges.sparkSession
    links = edges.select("edge_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    links = links.unionByName(links.select("edge_id", F.col("b").alias("a"), F.col("a").alias("b")))
    rims = {end: spark.createDataFrame([(end_id,)], "a string") for end, end_id in (("source", source), ("target", target))}
    seen, size = dict(rims), {"source": 1, "target": 1}
    levels: dict[str, list[DataFrame]] = {"source": [], "target": []}
    met = rims["source"] if source == target else None
    for _ in range(max_hops):
        if met is not None or not min(size.values()):
            break
        end = min(size, key=size.get)
        other = "target" if end == "source" else "source"
        # Levels are links (a, edge_id, b) from the rim outward from its end.
        step = links.join(broadcast_up_to(rims[end], 64), "a").join(broadcast_up_to(seen[end].withColumnRenamed("a", "b"), 64), "b", "left_anti")
        step = materialise(step.select("a", "edge_id", "b"), "level")
        levels[end].append(step)
        rims[end] = materialise(step.select(F.col("b").alias("a")).distinct(), "rim")
        seen[end], size[end] = seen[end].unionByName(rims[end]), rims[end].count()
        both = rims[end].join(rims[other], "a", "left_semi")
        met = None if both.isEmpty() else both
    paths = spark.createDataFrame([] if met is None else [(source, [source], [])], "at string, nodes array<string>, edges array<string>")

    def towards(end: str) -> list[DataFrame]:
        """Levels of an end, from it outward, cut to the links that lead to where the rims met."""
        at, out = met, []
        for level in reversed(levels[end]):
            out.insert(0, level.join(at.select(F.col("a").alias("b")), "b", "left_semi").select("a", "edge_id", "b"))
            at = out[0].select("a").distinct()
        return out

    there = [] if met is None else towards("source") + [x.select(F.col("b").alias("a"), "edge_id", F.col("a").alias("b")) for x in reversed(towards("target"))]
    for level in there:
        step = level.withColumnRenamed("a", "at").join(paths, "at")
        best = step.groupBy("b").agg(F.min(F.struct(F.concat("nodes", F.array("b")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"))).alias("p"))
        paths = materialise(best.select(F.col("b").alias("at"), "p.nodes", "p.edges"), "path")
    return paths.select((F.size("nodes") - 1).alias("hops"), "nodes", "edges")


def cross_language(edges: DataFrame, starts: DataFrame, max_hops: int, floor: float = 0.5) -> DataFrame:
    """(node_id, hop) over exposes and consumes links, either way, at or above a confidence."""
    return ego(edges.where(F.col("confidence") >= floor), starts, max_hops, ["exposes", "consumes"])


def expand_files(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, hops: int = 2, most: int = 20, decay: float = 0.6) -> DataFrame:
    """New files near candidates (repo_id, file_path, score): score * decay^hop, best source each, most in all.

    Hops advance together; the reference order of candidates only mattered for its cap, here the cap takes by hop, then score.
    """
    place = nodes.where("file_path is not null").select("node_id", "repo_id", "file_path")
    links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = materialise(candidates.select("repo_id", "file_path").distinct(), "seen")
    frontier = place.join(candidates, ["repo_id", "file_path"]).select("node_id", F.col("score").alias("base"))
    out = None
    for hop in range(1, hops + 1):
        step = links.join(frontier.withColumnRenamed("node_id", "a"), "a").join(place.withColumnRenamed("node_id", "b"), "b").join(seen, ["repo_id", "file_path"], "left_anti")
        new = materialise(step.groupBy("b", "repo_id", "file_path").agg(F.max("base").alias("base")), "files")
        files = new.groupBy("repo_id", "file_path").agg(F.least(F.max("base") * F.lit(decay**hop), F.lit(1.0)).alias("score")).withColumn("hop", F.lit(hop))
        out = files if out is None else out.unionByName(files)
        seen = seen.unionByName(files.select("repo_id", "file_path"))
        frontier = new.select(F.col("b").alias("node_id"), "base")
    return out.orderBy("hop", F.desc("score"), "repo_id", "file_path").limit(most)


def linked_documents(edges: DataFrame, node: str) -> DataFrame:
    """Documents of a node, parser-grade from confidence 0.9."""
    return edges.where((F.col("edge_type") == "documents") & ((F.col("source_id") == node) | (F.col("target_id") == node))).select("edge_id", F.when(F.col("source_id") == node, F.col("target_id")).otherwise(F.col("source_id")).alias("document_id"), F.when(F.col("confidence") >= 0.9, "parser").otherwise("heuristic").alias("grade"))


def change_type(paths: Column, public_api: Column, security: Column) -> Column:
    """Primary type of a change from its file paths (array) and two flags; several kinds are mixed."""

    def any_path(pattern: str) -> Column:
        return F.exists(paths, lambda p: p.rlike(pattern))

    kinds = F.array_compact(
        F.array(
            F.when(any_path(r"(?i)generated|auto_?generated|_pb2|_grpc|\.gen\."), "generated_file_change"),
            F.when(any_path(r"(?i)\.(proto|thrift|avro|openapi|swagger|idl|capnp|fbs)$"), "idl_schema_contract_change"),
            F.when(public_api, "public_api_change"),
            F.when(security | any_path(r"(?i)\b(sql|inject|cwe|permission|token|password|credential|secret|crypt|auth)\b"), "security_sensitive_change"),
        )
    )
    return F.when(F.size(kinds) == 0, "internal_implementation").when(F.size(kinds) > 1, "mixed").otherwise(F.get(kinds, F.lit(0)))


def reachability(alerts: DataFrame, changed: DataFrame) -> DataFrame:
    """Impact records of every supplied alert (alert_id, rule_id, severity), at one hop from the first changed symbol (symbol_id, place); no path is sought."""
    first = changed.agg(F.min_by("symbol_id", "place").alias("origin"))
    return alerts.crossJoin(F.broadcast(first)).select(F.coalesce("alert_id", F.lit("unknown")).alias("node_id"), F.lit("sarif_reachability").alias("impact_group"), F.lit(1).alias("hop"), "origin", F.lit("analyser").alias("confidence"), F.coalesce("severity", F.lit("warning")).isin("error", "critical").alias("breaking"), F.concat(F.lit("rule:"), F.coalesce("rule_id", F.lit("unknown"))).alias("notes"))


def policies(changes: DataFrame) -> DataFrame:
    """changes with max_hops and edge_types (sorted, empty for all) of their change_type; unknown ones as 'unknown'."""
    table = changes.sparkSession.createDataFrame([(k, h, sorted(t)) for k, (h, t) in POLICIES.items()], "change_type string, max_hops int, edge_types array<string>")
    known = F.when(F.col("change_type").isin(*POLICIES), F.col("change_type")).otherwise("unknown")
    return changes.withColumn("_p", known).join(F.broadcast(table.withColumnRenamed("change_type", "_p")), "_p").drop("_p")


def blast_report(confirmed: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(impact_group, nodes, nearest, farthest, analyser) of a blast radius, with ambiguous links as a group of their own."""
    g = confirmed.groupBy("impact_group").agg(F.count("*").alias("nodes"), F.min("hop").alias("nearest"), F.max("hop").alias("farthest"), F.count_if(F.col("grade") == "analyser").alias("analyser"))
    none = F.lit(None).cast("int")
    a = ambiguous.agg(F.count_distinct("source_id", "target_id", "edge_type").alias("nodes"))
    return g.unionByName(a.select(F.lit("ambiguous").alias("impact_group"), "nodes", none.alias("nearest"), none.alias("farthest"), F.lit(0).cast("long").alias("analyser")))


def patch_context(symbols: DataFrame) -> DataFrame:
    """(diff_id, changed, callers, tests, boundaries) of changed symbols (diff_id, symbol_id, is_boundary): ids made from the symbols, as nothing is traversed."""
    ids = F.array_sort(F.collect_set("symbol_id"))
    g = symbols.groupBy("diff_id").agg(ids.alias("changed"), F.array_sort(F.collect_set(F.when(F.col("is_boundary"), F.col("symbol_id")))).alias("boundaries"))
    named = lambda p: F.transform("changed", lambda x: F.concat(F.lit(p), x))
    return g.select("diff_id", "changed", named("caller:").alias("callers"), named("test:").alias("tests"), "boundaries")


def intent_edges(clauses: DataFrame, grounded: DataFrame) -> DataFrame:
    """specified_by edges of clauses to the nodes they are grounded in."""
    return clauses.join(grounded, "clause_id").select(F.concat_ws("|", F.lit("specified_by"), "clause_id", "node_id").alias("edge_id"), F.col("clause_id").alias("source_id"), F.col("node_id").alias("target_id"), F.lit("specified_by").alias("edge_type"))

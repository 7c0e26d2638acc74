"""Work that grows with the input: rows that joins give, rows shuffled and rows that one task reads, on tables with few large groups."""

import bisect
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers as an
from lodestone.operators import graph as gr
from lodestone.operators import graph_store as gs
from lodestone.operators import ledger as lg
from lodestone.operators import ranking as rk
from lodestone.sources import evidence as sv


@pytest.fixture
def work(spark):
    """A call of make() -> DataFrame with its rows and a dict: joined (most rows out of a join of the last plan), shuffled (rows), bytes (of them), task (most rows one task read from a shuffle)."""

    def joined(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from joined(plan.executedPlan())
        elif "QueryStage" in name:
            yield from joined(plan.plan())
        rows = plan.metrics().get("numOutputRows")
        if "Join" in name and rows.isDefined():
            yield rows.get().value()
        for k in range(plan.children().size()):
            yield from joined(plan.children().apply(k))

    def measure(make):
        jvm, gateway, store = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
        stages = lambda: store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        old = max((stages().apply(k).stageId() for k in range(stages().size())), default=-1)
        df = make()
        rows = df.collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        now = stages()
        own = [now.apply(k) for k in range(now.size()) if now.apply(k).stageId() > old]
        reads = []
        for s in own:
            tasks = store.taskList(s.stageId(), s.attemptId(), 10000)
            reads += [t.get().shuffleReadMetrics().recordsRead() for t in (tasks.apply(k).taskMetrics() for k in range(tasks.size())) if t.isDefined()]
        return rows, {"joined": max(joined(df._jdf.queryExecution().executedPlan()), default=0), "shuffled": sum(s.shuffleWriteRecords() for s in own), "bytes": sum(s.shuffleWriteBytes() for s in own), "task": max(reads, default=0)}

    return measure


@pytest.fixture
def spread(spark, work):
    """work over eight partitions that are not put together where they are small."""

    def measure(make):
        conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        old = {k: spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                spark.conf.set(k, v)
            return work(make)
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)

    return measure


def test_recover_meets_each_event_once(spark, work):
    day = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {}, 0)"
    log = spark.range(40000).select(F.when(F.col("id") % 4 > 0, F.concat(F.lit("r"), F.col("id") % 2)).alias("resource"), F.expr(day.format("int(id div 7)")).alias("ts"))
    c = spark.range(20000).select(F.concat(F.lit("c"), "id").alias("client"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("r"), F.col("id") % 3)).alias("resource"), F.when(F.col("id") % 11 > 0, F.expr(day.format("int(id * 3 % 6000)"))).alias("last_ts"))
    as_of, window = F.expr(day.format("5800")), 180000
    n = lambda x: None if x is None else int(x.timestamp()) // 60
    t0 = n(spark.sql(f"select {day.format('0')}").first()[0])
    times = {}
    for r in log.where("resource is not null").collect():
        times.setdefault(r.resource, []).append(n(r.ts) - t0)
    times = {k: sorted(v) for k, v in times.items()}
    want = {}
    for r in c.collect():
        own = times.get(r.resource, [])
        at = None if r.last_ts is None else bisect.bisect_right(own, n(r.last_ts) - t0)
        missed = 0 if at is None else len(own) - at
        what = "none" if not own else "resync" if at is None else "none" if not missed else "resync" if (5800 - own[at]) * 60 > window else "replay"
        want[r.client] = (r.resource, what, missed if what == "replay" else 0)
    rows, did = work(lambda: lg.recover(c, log, as_of, window))
    assert {r.client: (r.resource, r.action, r.replayed) for r in rows} == want and len(rows) == 20000 and {v[1] for v in want.values()} == {"none", "resync", "replay"}
    assert did["joined"] <= 20000


def brute_evidence(questions, nodes, most):
    """Evidence of asked questions, one question and node at a time."""
    plain = lambda x: "".join(c for c in x.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    out = set()
    for q in questions:
        sure, near = set(), set()
        for n in nodes:
            if n.repo_id != q.repo_id:
                continue
            for token in q.tokens:
                if q["class"] == "file_location":
                    if n.file_path is not None and n.file_path.endswith(token) and n.file_path.split("/")[-1] == token.split("/")[-1]:
                        sure.add(n.node_id)
                else:
                    if token in (n.label, n.qualified_name):
                        sure.add(n.node_id)
                    if plain(token) and n.label is not None and plain(n.label) == plain(token):
                        near.add(n.node_id)
        out |= {(q.question_id, i, "parser" if sure else "heuristic") for i in sorted(sure or near)[:most]}
    return out


def test_evidence_looks_a_token_up_once(spark, work):
    i = F.col("id")
    paths = F.array(*map(F.lit, ("a.py", "src/a.py", "x/src/a.py", "rc/b.py", "src/b.py", "b.py/", "ba.py")))
    nodes = spark.range(400).select(F.concat(F.lit("n"), i).alias("node_id"), F.when(i % 3 > 0, "r").otherwise("s").alias("repo_id"), F.when(i % 13 > 0, F.concat(F.lit("La-Bel"), i % 5)).alias("label"), F.concat(F.lit("q."), i % 9).alias("qualified_name"), F.when(i % 11 > 0, F.get(paths, (i % 7).cast("int"))).alias("file_path"))
    nodes = nodes.unionByName(nodes.where("node_id < 'n2'"))
    words = [["a.py"], ["rc/b.py", "a.py"], ["src/a.py"], ["/"], ["y.py", "/b.py"], ["b.py/"], ["La-Bel1"], ["labEL2", "q.3"], ["label4", "LABEL3"], ["--"], [], ["q.1", "La-Bel1"]]
    asked = [(k, "rs"[k % 2], "file_location" if k % 24 < 12 else "symbol_location", words[k % 12]) for k in range(600)]
    asked = spark.createDataFrame(asked, "question_id int, repo_id string, class string, tokens array<string>")
    for most in (20, 3):
        rows, did = work(lambda: an.evidence(asked, nodes, most))
        assert {tuple(r) for r in rows} == brute_evidence(asked.collect(), nodes.collect(), most) and len(rows) == len({r[:2] for r in rows})
        assert did["joined"] <= 2000


def test_behaviour_traces_of_a_common_name(spark, work):
    nodes = spark.range(1000).select(F.format_string("n%04d", 999 - F.col("id")).alias("node_id"), F.lit("r").alias("repo_id"), F.lit("run").alias("label"), F.lit("m.run").alias("qualified_name"), F.lit("m.py").alias("file_path"))
    texts = ["How does `run` flow", "How does `m.run` work", "How does it happen", "How does `other` flow"]
    q = spark.createDataFrame([(k, "r", texts[k % 4]) for k in range(400)], "question_id int, repo_id string, text string")
    asked = an.intents(q)
    rows, did = work(lambda: an.traces(asked, an.evidence(asked, nodes)))
    want = {0: (["n0000"], "heuristic", None), 1: (["n0000"], "heuristic", None), 2: (None, "unknown", "NO_START_SYMBOL"), 3: (None, "unknown", "NO_START_NODE")}
    assert {r.question_id: (r.path, r.confidence, r.diagnostic) for r in rows} == {k: want[k % 4] for k in range(400)}
    assert did["joined"] <= 2000


def test_byte_cap_shuffles_no_rows(spark, work):
    i = F.col("id")
    d = spark.range(3000).select(i, F.when(i % 7 > 0, F.when(i % 7 > 5, "b").otherwise("a")).alias("g"), F.when(i % 1000 > 3, (i * 37 % 1500)).alias("at"), F.when(i % 5 > 0, F.repeat(F.lit("é"), (i % 90).cast("int"))).alias("text"), F.lit("old").alias("truncated"))
    groups = {}
    for r in d.collect():
        groups.setdefault(r.g, {}).setdefault(-1 if r["at"] is None else r["at"], []).append(r)
    for most in (0, 1, 200, 9000, 1 << 30):
        want, size = set(), lambda r: None if r.text is None else 2 * len(r.text) + 1
        for g, by in groups.items():
            run, whole = None, sum(size(r) or 0 for rs in by.values() for r in rs)
            for at in sorted(by):
                for n in map(size, by[at]):
                    run = run if n is None else (run or 0) + n
                if run is not None and run <= most:
                    want |= {(r.id, whole > most) for r in by[at]}
        rows, did = work(lambda: lg.byte_cap(d, "g", "at", "text", most))
        assert {(r.id, r.truncated) for r in rows} == want and len(rows) == len(want)
    assert len(want) == 3000 and d.columns == rows[0].__fields__
    wide = spark.range(3000).select("id", F.lit("a").alias("g"), F.repeat(F.uuid(), 3).alias("text")).persist()
    _, did = work(lambda: lg.byte_cap(wide, "g", "id", "text", 5000))
    assert did["bytes"] < 60000
    wide.unpersist()


def test_tiers_of_a_large_group(spark, work):
    i = F.col("id")
    d = spark.range(3000).select(i, F.when(i % 9 > 0, F.when(i % 9 > 1, "a").otherwise("b")).alias("g"), (i % 4).alias("h"))
    tiers = [i % 8 == 7, i % 2 == 1, i > 100]
    first = lambda k: next((n for n, c in enumerate((k % 8 == 7, k % 2 == 1, k > 100), 1) if c), None)
    least = {}
    for r in d.collect():
        if first(r.id):
            least[r.g, r.h] = min(first(r.id), least.get((r.g, r.h), 9))
    rows, did = work(lambda: rk.tiered(d, tiers, ["g", "h"]))
    assert {(r.id, r.tier) for r in rows} == {(r.id, first(r.id)) for r in d.collect() if first(r.id) and first(r.id) == least[r.g, r.h]}
    assert rows[0].__fields__ == ["id", "g", "h", "tier"] and did["task"] < 200


def test_chunks_of_a_large_module(spark, spread):
    i = F.col("id")
    n = spark.range(4000).select(F.when(i % 40 > 0, F.when(i % 40 > 3, "a").otherwise("b")).alias("repo_id"), F.concat(F.lit("n"), i * 7 % 4001).alias("node_id"), F.when(i % 9 > 0, F.when(i % 9 > 1, "m/x.py").otherwise(F.concat(F.lit("k"), i % 50, F.lit("/y.py")))).alias("file_path")).where("repo_id is not null")
    want, at = set(), {}
    by = {}
    for r in n.collect():
        by.setdefault(r.repo_id, {}).setdefault(r.file_path.rsplit("/", 1)[0] if r.file_path else "", []).append(r.node_id)
    for repo, modules in by.items():
        chunk, held = 0, 0
        for m in sorted(modules):
            ids = sorted(modules[m])
            for k in range(0, len(ids), 30):
                if held and held + len(ids[k : k + 30]) > 30:
                    chunk, held = chunk + 1, 0
                held += len(ids[k : k + 30])
                want |= {(repo, chunk, i) for i in ids[k : k + 30]}
    rows, did = spread(lambda: gs.chunk_by_module(n, 30))
    assert {tuple(r) for r in rows} == want and len(rows) == 3900
    assert did["task"] < 2500


def test_manifest_shuffles_rows_once(spark, spread, tmp_path):
    i = F.col("id")
    nodes = spark.range(1003).select(F.concat(F.lit("n"), i * 7 % 1009).alias("node_id"), F.when(i % 3 > 0, i).alias("x"))
    edges = spark.range(5000).select(F.concat(F.lit("e"), i.cast("int").bitwiseAND(F.lit(2047))).alias("edge_id"), (i % 5).alias("w"), F.repeat(F.md5(i.cast("string")), 4).alias("pad"))
    rows, did = spread(lambda: sv.write_manifest(nodes, edges, str(tmp_path / "m"), 100))
    want = set()
    for kind, df, key in (("nodes", nodes, "node_id"), ("edges", edges, "edge_id")):
        lines = [r.j for r in df.select(key, F.to_json(F.struct(*df.columns)).alias("j")).orderBy(key, "j").collect()]
        for k in range(0, len(lines), 100):
            part = lines[k : k + 100]
            want.add((kind, k // 100, len(part), hashlib.sha256("\n".join(part).encode()).hexdigest()))
            assert sorted(r.value for r in spark.read.text(str(tmp_path / "m" / kind / f"chunk={k // 100}")).collect()) == sorted(part) if k % 1000 == 0 else True
    assert {(r.kind, r.chunk, r.rows, r.sha256) for r in rows} == want and len(rows) == len(want)
    assert did["shuffled"] < 6003 * 1.3


def wide_graph(spark):
    """5,000 edges off the few that start at a."""
    i = F.col("id")
    far = spark.range(5000).select(F.concat(F.lit("e"), i).alias("edge_id"), F.lit("calls").alias("edge_type"), F.concat(F.lit("x"), i % 900).alias("source_id"), F.concat(F.lit("y"), i % 700).alias("target_id"), F.lit(0.9).alias("confidence"))
    near = [("ab", "a", "b", 0.9), ("ac", "a", "c", 0.8), ("bd", "b", "d", 0.9), ("cd", "c", "d", 0.9), ("cw", "c", "w", 0.1), ("de", "d", "e", 0.95), ("da", "d", "a", 0.9)]
    near = spark.createDataFrame([(k, "calls", s, t, c) for k, s, t, c in near], far.schema)
    return far.unionByName(near)


def test_blast_radius_shuffles_no_far_edges(spark, work):
    e = wide_graph(spark)
    n = spark.range(3000).select(F.concat(F.lit("z"), "id").alias("node_id"), F.lit("class").alias("node_type")).unionByName(spark.createDataFrame([("d", "test"), ("e", "interface")], "node_id string, node_type string"))
    rows, did = work(lambda: gr.blast_radius(e, n, ["a"])[0])
    assert sorted((r.node_id, r.node_type, r.hop, r.path, r.grade, r.impact_group) for r in rows) == [("b", "symbol", 1, ["a"], "analyser", "direct_callers"), ("c", "symbol", 1, ["a"], "heuristic", "direct_callers"), ("d", "test", 2, ["a", "b"], "analyser", "tests"), ("e", "interface", 3, ["a", "b", "d"], "analyser", "interfaces")]
    assert did["shuffled"] < 200


def test_blast_report_shuffles_no_far_edges(spark, work):
    e = wide_graph(spark)
    n = spark.range(3000).select(F.concat(F.lit("z"), "id").alias("node_id"), F.lit("class").alias("node_type"))
    rows, did = work(lambda: gr.blast_report(*gr.blast_radius(e, n, ["a"])))
    assert sorted((r.impact_group, r.nodes, r.nearest, r.farthest, r.analyser) for r in rows) == [("ambiguous", 1, None, None, 0), ("direct_callers", 2, 1, 1, 1), ("downstream_behaviours", 2, 2, 3, 2)]
    assert did["shuffled"] < 200


def brute_path(edges, source, target, most):
    """The least path by looking at all of them, a hop at a time."""
    links = [(a, b, k) for k, s, t in edges for a, b in ((s, t), (t, s))]
    paths = [([source], [])]
    for hops in range(most + 1):
        ends = [p for p in paths if p[0][-1] == target]
        if ends:
            return [(hops, *min(ends))]
        paths = [(n + [b], e + [k]) for n, e in paths for a, b, k in links if a == n[-1] and b not in n]
    return []


def test_shortest_path_from_both_ends(spark, work):
    rng = random.Random(3)
    for k in range(8):
        e = [(f"e{i}", f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for i in range(rng.randrange(6, 14))]
        df = spark.createDataFrame(e, "edge_id string, source_id string, target_id string")
        assert [tuple(r) for r in gr.shortest_path(df, "n0", "n1", 2 + k % 4).collect()] == brute_path(e, "n0", "n1", 2 + k % 4), e
    rows, did = work(lambda: gr.shortest_path(wide_graph(spark), "a", "e", 4))
    assert [tuple(r) for r in rows] == [(2, ["a", "d", "e"], ["da", "de"])] and did["shuffled"] < 100


def endpoints(spark):
    """(edges, nodes): of 4,000 edges over 900 nodes one in forty has a null end, a node is missing for one in fifteen, ids occur twice."""
    i = F.col("id")
    end = lambda c: F.when(i % 40 > 0, F.concat(F.lit("n"), c))
    e = spark.range(4000).select(F.concat(F.lit("e"), i % 3900).alias("edge_id"), end(i % 900).alias("source_id"), F.when(i % 41 > 0, end(i * 7 % 870)).alias("target_id"))
    return e, spark.range(900).where("id % 30 > 0").select(F.concat(F.lit("n"), i).alias("node_id")).unionByName(spark.createDataFrame([("n1",), (None,)], "node_id string"))


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_edges_with_absent_nodes_are_not_shuffled(spark, work, threshold):
    e, n = endpoints(spark)
    have = {r.node_id for r in n.collect()}
    assert None in have
    bad = {r.edge_id: r.source_id for r in e.collect() if r.source_id not in have or None in tuple(r) or r.target_id not in have}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows, did = work(lambda: gs.dangling(e, n))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {r.edge_id for r in rows} == set(bad) and len(rows) == len(bad)
    for r in rows:
        assert r.missing == ("source_id" if r.source_id not in have - {None} else "target_id")
    # Distinct endpoints of each task, the nodes and the rows that are returned.
    assert did["shuffled"] < 900 * 4 + 900 + len(bad) * 2


def test_edges_with_known_nodes_are_not_shuffled(spark, work, monkeypatch):
    e, n = endpoints(spark)
    have = {r.node_id for r in n.collect()} - {None}
    want = {r.edge_id for r in e.collect() if r.source_id in have and r.target_id in have}
    spread = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    # Nodes that may not travel, and nodes that may.
    few = gs.broadcast_up_to
    try:
        for limit in (0, 64 << 20):
            monkeypatch.setattr(gs, "broadcast_up_to", lambda df, width: few(df, width, limit if df.columns == ["id"] and not hasattr(df, "_lodestone_path") else 64 << 20))
            rows, did = work(lambda: gs.insert_edges(e, n))
            assert {r.edge_id for r in rows} == want and len(rows) == len(want)
            assert did["shuffled"] < len(want) + 900 * 4 + 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", spread)

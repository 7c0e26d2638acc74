"""Semantics that the stand-in queries do not reach, by hand-made rows."""

import math

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluation as ev
from lodestone.operators import graph as gr
from lodestone.operators import graph_store as gs
from lodestone.operators import indexers as ix
from lodestone.operators import ledger as lg
from lodestone.operators import ranking as rk
from lodestone.operators import sarif as sa

ALERT = "analyser_id string, rule_id string, file_path string, start_line int, message string, severity string, suppressed boolean"


def events(spark, actions):
    return spark.createDataFrame([("r", i, f"e{i}", "t", "s", a) for i, a in enumerate(actions)], "run_id string, seq int, event_id string, type string, stage string, policy_action string")


def test_denial_streaks(spark):
    for n, want in ((2, 0), (3, 1), (5, 1), (6, 2), (7, 2), (9, 3)):
        assert lg.denial_storms(events(spark, ["deny"] * n + ["allow"])).count() == want


def test_gate_failures_and_code_change(spark):
    e = spark.createDataFrame([("r", i, t, "g") for i, t in enumerate(["gate_failed"] * 3)], "run_id string, seq int, type string, stage string")
    assert lg.failing_gates(e).count() == 1
    change = spark.createDataFrame([("r", 9, "code_change", "g")], e.schema)
    assert lg.failing_gates(e.unionByName(change)).count() == 0


def test_delta_classes(spark):
    a = lambda r, line, m, s="medium": ("x", r, "f.py", line, m, s, False)
    before = spark.createDataFrame([a("same", 12, "m"), a("old", 16, "m"), a("far", 10, "m"), a("msg", 10, "one")], ALERT)
    after = spark.createDataFrame([a("same", 12, "m"), a("old", 20, "m"), a("far", 30, "m"), a("msg", 300, "two"), a("new", 17, "n", "high")], ALERT)
    got = sorted(((r.change, r.change_type) for r in sa.delta(before, after).collect()), key=str)
    assert got == sorted([("unchanged", None), ("changed", "location_shifted"), ("disappeared", None), ("appeared", None), ("changed", "message_changed"), ("appeared", None)], key=str)


def test_leftovers_are_matched_as_by_looking_at_all():
    import random

    r = random.Random(3)
    for _ in range(300):
        old = [(r.randint(0, 30), r.choice("abc")) for _ in range(r.randint(0, 12))]
        new = [(r.randint(0, 30), r.choice("abc")) for _ in range(r.randint(0, 12))]
        left, want = list(range(len(new))), []
        for line, message in old:
            k = next((k for k in left if abs(new[k][0] - line) <= 5 or new[k][1] != message), -1)
            want.append(k)
            if k >= 0:
                left.remove(k)
        assert sa.match_leftovers(old, new) == want


def test_delta_of_one_empty_side(spark):
    none = spark.createDataFrame([], ALERT)
    one = spark.createDataFrame([("x", "r", None, None, "m", "low", False)], ALERT)
    assert [r.change for r in sa.delta(none, one).collect()] == ["appeared"]
    assert [r.change for r in sa.delta(one, none).collect()] == ["disappeared"]


def test_blast_radius_orders(spark):
    e = spark.createDataFrame([(s, t, "calls", 0.9) for s, t in ("ab", "bc", "cd", "de", "zc")] + [("b", "w", "calls", 0.4)], "source_id string, target_id string, edge_type string, confidence double")
    n = spark.createDataFrame([("b", "test")], "node_id string, node_type string")

    def hops(starts, order):
        return {r.node_id: r.hop for r in gr.blast_radius(e, n, starts, "generated_file_change", start_order=order)[0].collect()}

    assert hops(["a", "z"], "sequential") == {"b": 1, "c": 2}
    assert hops(["z", "a"], "sequential") == {"c": 1, "d": 2, "b": 1}
    assert hops(["a", "z"], "level") == {"b": 1, "c": 1, "d": 2}
    assert [r.target_id for r in gr.blast_radius(e, n, ["a"])[1].collect()] == ["w"]


def test_shortest_path(spark):
    e = spark.createDataFrame([(a + b, a, b) for a, b in ("ab", "bc", "ad", "dc", "ce")] + [("ab2", "b", "a")], "edge_id string, source_id string, target_id string")
    assert [(r.hops, r.nodes, r.edges) for r in gr.shortest_path(e, "a", "e", 5).collect()] == [(3, ["a", "b", "c", "e"], ["ab", "bc", "ce"])]
    assert gr.shortest_path(e, "a", "e", 2).count() == 0
    assert [(r.hops, r.edges) for r in gr.shortest_path(e, "a", "a", 2).collect()] == [(0, [])]


def test_calibration_of_nothing(spark):
    none = spark.createDataFrame([], "predicted_probability double, predicted_label string, gold_label string, family string")
    assert ev.ece(none).first().ece == 1.0 and ev.macro_f1(none).first().macro_f1 == 0.0
    assert not ev.calibration_report(none).first().passed


def test_flakiness_threshold(spark):
    rows = [("a", i > 0) for i in range(20)] + [("b", True)] * 3 + [("c", True), ("c", False)]
    got = {r.instance_id: (round(r.entropy, 4), r.flaky) for r in ev.flakiness(spark.createDataFrame(rows, "instance_id string, ok boolean")).collect()}
    assert got == {"a": (0.2864, False), "b": (0.0, False), "c": (1.0, True)}


def test_cwe_and_routes(spark):
    r = spark.range(1).select(sa.cwe_ids(F.lit("rule 12 of OWASP 2021"), F.lit("CWE-89")).alias("c"), tx.route_match(F.lit("/a/<int:id>/"), F.lit("/a/:id")).alias("p"), tx.route_match(F.lit("/a/{x}"), F.lit("/a/{y}")).alias("s"), tx.route_match(F.lit("/a/b"), F.lit("/a")).alias("h"), tx.route_match(F.lit("/a"), F.lit("/b")).alias("n")).first()
    assert r.c == ["CWE-12", "CWE-89", "CWE-2021"] and (r.p, r.s, r.h, r.n) == ("parser", "analyser", "heuristic", None)


def test_diff_parsing(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -3,2 +4,3 @@ def f\n-old\n+new\n+if y:\n--- a/z.py\n+++ b/z.py\n@@ -1 +1 @@\n+raise E\n"
    d = spark.createDataFrame([("d", diff)], "diff_id string, diff string")
    assert [tuple(r) for r in tx.diff_totals(d).select("added", "removed", "files", "hunks", "net").collect()] == [(3, 1, 2, 2, 2)]
    assert [(r.file, r.old_start, r.new_start) for r in tx.diff_lines(d).orderBy("line_no").limit(1).collect()] == [("x.py", 3, 4)]
    assert tx.diff_features(d).first().edit_operation == "conditional_inserted"
    assert d.select(tx.maintainability(F.col("diff")).alias("m")).first().m.locality == 0.8


def test_clauses(spark):
    text = "The tool must log. It must do all of:\n\n- `cmd.py` runs\n- see [x](y)\nIt shall, and must, stop.\n\n| A | B |\n|---|---|\n| 1 | - |\n| 2 | 3 |\n"
    d = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert [(r.clause, r.atomic) for r in tx.normative_clauses(d).orderBy("line_no", "pos").collect()] == [("The tool must log.", True), ("It shall, and must, stop.", False)]
    assert [r.clause for r in tx.table_clauses(d).orderBy("line_no").collect()] == ["A: 1", "A: 2; B: 3"]
    assert [r.clause for r in tx.bullet_clauses(d).collect()] == ["`cmd.py` runs"]


def test_redaction_and_secret_paths(spark):
    d = spark.createDataFrame([('{"a": {"k": ["x", "password = abcdefgh1"]}}', "mail me@x.org Bearer abc.def")], "j string, t string")
    r = d.select(tx.secret_paths(F.col("j")).alias("p"), tx.redact(F.col("t"), rules={"mail": "post"}).alias("t")).first()
    assert r.p == [".a.k[1]"] and r.t == "post [REDACTED] [REDACTED]"


def test_stack_frames_and_files(spark):
    t = 'Boom in src/a.py\n  File "src/a.py", line 3, in f\n    at run (lib/b.ts:7:1)\nx.cpp:12: error\nValueError: no'
    r = spark.createDataFrame([(t,)], "t string").select(tx.stack_frames(F.col("t")).alias("f"), tx.error_strings(F.col("t")).alias("e"), tx.issue_files(F.col("t")).alias("n")).first()
    assert r.f == ["src/a.py:3", "lib/b.ts:7", "x.cpp:12"] and r.e == ["ValueError"] and r.n[0] == "src/a.py"


def test_chunks_pack_whole_modules(spark):
    n = spark.createDataFrame([("r", f"{m}/f{i}.py", f"{m}{i}") for m, k in (("a", 3), ("b", 2), ("c", 4), ("d", 9)) for i in range(k)], "repo_id string, file_path string, node_id string")
    got = {}
    for r in gs.chunk_by_module(n, 5).collect():
        got.setdefault(r.chunk, []).append(r.node_id[0])
    assert {k: "".join(sorted(v)) for k, v in got.items()} == {0: "aaabb", 1: "cccc", 2: "ddddd", 3: "dddd"}


PY = "import os\nfrom . import b\nfrom pkg.c import thing as t\nfrom zzz import q\n\nclass A:\n    def m(self):\n        self.n()\n        helper()\n    def n(self):\n        self.n()\n\ndef helper():\n    return A()\n"


def files(spark):
    return spark.createDataFrame([("r", "src/pkg/a.py", PY), ("r", "src/pkg/b.py", "x = 1"), ("r", "src/pkg/c.py", "def ("), ("r", "w.ts", "import x from './y'\nexport class K {}\nexport async function go() {}\nconst f = (a) => a\n"), ("r", "m.cpp", '#include "h.hpp"\nstruct S {\n};\nint add(int a, int b) {\n return a;}\n'), ("r", "J.java", "package p.q;\nimport java.util.List;\npublic class J {\n  public static int go(int a) {\n return 1; }\n}\n"), ("r", "d.md", "# Top\n```\n# no\n```\n## Sub ##\n"), ("r", "api.py", "@app.get('/u/<int:id>')\ndef f(): pass"), ("r", "cl.py", "requests.get('/u/{id}')")], "repo_id string, path string, text string")


def test_python_index(spark):
    facts = ix.python_facts(files(spark)).persist()
    assert {(r.kind, r.qualified) for r in facts.where("path = 'src/pkg/a.py' and def_order > 0").collect()} == {("class", "pkg.a.A"), ("method", "pkg.a.A.m"), ("method", "pkg.a.A.n"), ("function", "pkg.a.helper")}
    assert facts.where("kind = 'error'").count() == 1
    assert {(r.source, r.target) for r in ix.call_edges(facts).collect()} == {("pkg.a.A.m", "pkg.a.A.n"), ("pkg.a.A.m", "pkg.a.helper"), ("pkg.a.helper", "pkg.a.A")}
    assert {(r.target, r.status, r.target_path) for r in ix.imports(facts).collect()} == {("os", "external_dependency", None), (".:b", "unresolved", None), ("pkg.c:thing", "resolved_internal", "src/pkg/c.py"), ("zzz:q", "external_dependency", None)}


def test_regex_indexes(spark):
    f = files(spark)
    of = lambda lang: {(r.kind, r.name) for r in ix.regex_symbols(f, lang).collect()}
    assert of("typescript") == {("import", "./y"), ("class", "K"), ("function", "go"), ("arrow", "f")}
    assert of("cpp") == {("include", "h.hpp"), ("class", "S"), ("function", "add")}
    assert {("package", "p.q"), ("import", "java.util.List"), ("class", "J"), ("method", "go")} <= of("java")
    assert [(r.line, r.level, r.title) for r in ix.markdown_headings(f).orderBy("line").collect()] == [(1, 1, "Top"), (5, 2, "Sub")]
    assert [(r.provider, r.consumer) for r in ix.interface_links(ix.interfaces(f, "http")).collect()] == [("api.py", "cl.py")]


def test_keyword_candidates_name_files_and_symbols(spark):
    rows = [("r", "n1", "parse", "m.parse", "a.py"), ("r", "n2", "other", "m.other", "a.py"), ("r", "n3", "lexer", "m.lexer", "b.py"), ("r", "n4", "zed", None, "c.py"), ("r", "n5", "parse", "x.parse", None), ("r", "n6", "none", "q.none", "d.py")]
    nodes = spark.createDataFrame(rows, "repo_id string, node_id string, label string, qualified_name string, file_path string")
    got = {r.file_path: (r.node_id, r.score) for r in rk.keyword_candidates(nodes, "parsing of", ["b.py"], ["zed"]).collect()}
    py, zed = math.log(7 / 6 + 1), math.log(7 / 2 + 1)
    want = {"a.py": ("n1", py), "b.py": ("n3", 2.0 + py), "c.py": ("n4", 1.5 + zed + py), "d.py": ("n6", py)}
    top = max(v for _, v in want.values())
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(abs(got[k][1] - v / top) < 1e-9 for k, (_, v) in want.items())


def test_topics_and_filters(spark):
    from lodestone.operators import contracts as ct

    rows = [("a/b", "a/b", True), ("a/b", "a/+", True), ("a/b/c", "a/+", False), ("a/b/c", "a/#", True), ("a", "a/#", True), ("ab", "a/#", False), ("a/b", "#", True), ("a.b", "a+b", False), ("axb", "a.b", False), ("/x", "+/x", True)]
    d = spark.createDataFrame(rows, "t string, f string, want boolean")
    assert d.where(ct.topic_matches(F.col("t"), F.col("f")) != F.col("want")).collect() == []


def test_registry_refuses_and_reloads():
    import pytest

    from lodestone.operators import registry as rg

    r = rg.backends()
    with pytest.raises(ValueError):
        r.register(r.entries["java"])
    assert r.for_path("x/a.tsx") == ["typescript"] and r.for_path("a.rs") == []
    assert r.reload([r.entries["java"]], {"java"}) == ([], ["cpp", "python", "typescript"]) and r.active() == []
    with pytest.raises(ValueError):
        rg.resource({}, "nowhere://x")


def test_ruleset_ids():
    import pytest

    from lodestone.operators import repair as rp

    assert rp.ruleset([]) == rp.ruleset(["default"]) and rp.ruleset(["a"])[0] != rp.ruleset(["b"])[0]
    assert rp.ruleset(["f"], {"f": "x"})[0] == rp.ruleset(["x"])[0]
    with pytest.raises(ValueError):
        rp.ruleset(["p/python"])


def test_a_cluster_needs_a_shared_folder():
    import pytest

    from lodestone.session import shared_dir

    class Conf:
        def get(self, key, default):
            return default

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "local-cluster[2,1,512]"})()

    with pytest.raises(ValueError):
        shared_dir(Fake())

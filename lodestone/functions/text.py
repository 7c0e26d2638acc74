"""Column functions over text: ids, redaction, URLs, diffs, clauses, change risk (FUN, IDX-28/29, WIN-09..12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

_NAME = r"(?:passw(?:or)?d|secret|token|(?:api|private|access)[_\-]?key)"
SECRETS = (rf"(?i){_NAME}\s*[=:]\s*['\"]?[\w+/=\-]{{8,}}['\"]?", r"(?i)bearer\s+[\w\-.~+/]+=*", r"ghp_[A-Za-z0-9]{36}", r"sk-[A-Za-z0-9]{32,}")
PERSONAL = (r"\b[\w.%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",)


def short_id(prefix: str, digits: int, *parts: Column) -> Column:
    """prefix and the first hex digits of sha-256 over the parts; null parts are empty."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, digits))


def node_id(repo: Column, kind: Column, qualified: Column, path: Column) -> Column:
    return short_id("node:", 24, repo, kind, qualified, path)


def edge_id(repo: Column, kind: Column, source: Column, target: Column) -> Column:
    return short_id("edge:", 24, repo, kind, source, target)


def snapshot_key(worktree: Column, sha: Column, repo: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(F.nullif(worktree, F.lit("")), F.nullif(sha, F.lit("")), repo)


def redact(text: Column, secrets: bool = True, personal: bool = True, rules: dict[str, str] | None = None) -> Column:
    for p in (*(SECRETS if secrets else ()), *(PERSONAL if personal else ())):
        text = F.regexp_replace(text, p, REDACTED)
    for p, r in (rules or {}).items():
        text = F.regexp_replace(text, p, r)
    return text


def has_secret(text: Column) -> Column:
    c = F.lit(False)
    for p in SECRETS:
        c = c | text.rlike(p)
    return F.coalesce(c, F.lit(False))


def secret_paths(json: Column) -> Column:
    """Paths of strings in a JSON document that hold a secret; [] for invalid JSON."""
    @F.pandas_udf("array<string>")
    def walk(docs: pd.Series) -> pd.Series:
        import json as j
        import re

        found = [re.compile(p, re.ASCII) for p in SECRETS]

        def go(x, path: str):
            if isinstance(x, dict):
                for k, v in x.items():
                    yield from go(v, f"{path}.{k}")
            elif isinstance(x, list):
                for i, v in enumerate(x):
                    yield from go(v, f"{path}[{i}]")
            elif isinstance(x, str) and any(p.search(x) for p in found):
                yield path

        def one(d):
            try:
                return list(go(j.loads(d), "")) if d is not None else []
            except ValueError:
                return []

        return docs.map(one)

    return walk(json)


def url_path(raw: Column) -> Column:
    """Path of a URL or route with {name} parameters, single slashes and no final slash."""
    t = F.trim(raw)
    full = t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://|^//")
    path = F.when(full, F.regexp_extract(t, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)).otherwise(F.regexp_extract(raw, r"(?s)^([^?]*)", 1))
    path = F.regexp_replace(path, r"<(?:[^:<>]+:)?([^<>]+)>", "{$1}")
    path = F.regexp_replace(path, r":([A-Za-z_]\w*)", "{$1}")
    path = F.regexp_replace(path, "//+", "/")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    return F.when(path == "", "/").otherwise(path)


def route_match(left: Column, right: Column) -> Column:
    """parser for equal paths, analyser for equal shapes, heuristic where one shape begins the other, else null."""
    a, b = url_path(left), url_path(right)
    x, y = F.regexp_replace(a, r"\{[^}]+\}", "{}"), F.regexp_replace(b, r"\{[^}]+\}", "{}")
    return F.when(a == b, "parser").when(x == y, "analyser").when(x.startswith(y) | y.startswith(x), "heuristic")


def diff_files(diff: Column) -> Column:
    """Distinct b/ files of a unified diff, in order."""
    return F.array_distinct(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1)))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, line_no, kind, file, hunk, old_start, new_start, text) of added and removed lines inside hunks."""
    lines = diffs.select("diff_id", F.posexplode(F.split("diff", "\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").startswith("+++ b/")
    at = F.col("line").startswith("@@") & ~head
    own = lines.withColumn("file", F.last(F.when(head, F.substring("line", 7, 1 << 30)), ignorenulls=True).over(w)).withColumn("hunk", F.sum(F.when(at, 1).otherwise(0)).over(w))
    own = own.withColumn("_h", F.last(F.when(at, F.col("line")), ignorenulls=True).over(w))
    kind = F.when(F.col("line").startswith("+") & ~F.col("line").startswith("+++"), "added").when(F.col("line").startswith("-") & ~F.col("line").startswith("---"), "removed")
    start = lambda p: F.coalesce(F.nullif(F.regexp_extract("_h", p, 1), F.lit("")).cast("int"), F.lit(0))
    return own.withColumn("kind", kind).where("kind is not null and hunk > 0").select("diff_id", "line_no", "kind", F.coalesce("file", F.lit("")).alias("file"), "hunk", start(r"-(\d+)").alias("old_start"), start(r".* \+(\d+)").alias("new_start"), F.substring("line", 2, 1 << 30).alias("text"))


def diff_totals(diffs: DataFrame) -> DataFrame:
    g = diff_lines(diffs).groupBy("diff_id").agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"), F.count_distinct("file").alias("files"), F.count_distinct("hunk").alias("hunks"))
    return g.withColumn("net", F.col("added") - F.col("removed"))


def diff_features(diffs: DataFrame) -> DataFrame:
    """Edit operation and signature features of a diff's lines."""
    lines = diff_lines(diffs)
    join = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    g = lines.groupBy("diff_id").agg(join("added").alias("a"), join("removed").alias("r"), F.count("*").alias("edit_distance"))
    a, r = F.col("a"), F.col("r")
    signature = a.contains("def ") | r.contains("def ")
    op = F.when(a.contains("if "), "conditional_inserted").when(a.contains("for ") | a.contains("while "), "loop_inserted").when(a.contains("except ") | a.contains("raise "), "exception_handler_changed").when(signature, "signature_change").otherwise("body_change")
    commas = lambda c: F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    return g.select("diff_id", "edit_distance", op.alias("edit_operation"), signature.alias("signature_changed"), (a.contains("->") | r.contains("->")).alias("return_type_changed"), (commas(a) - commas(r)).alias("parameter_delta"), a.contains("raise ").alias("raises"), r.contains("@secure").alias("guard_removed"))


def maintainability(diff: Column) -> Column:
    """struct(locality, passed) by substring checks."""
    defs = (F.length(diff) - F.length(F.replace(diff, F.lit("def "), F.lit("")))) / 4
    ok = (defs <= 10) & ~F.lower(diff).contains("duplicate") & ~diff.contains("global ") & ~diff.contains("time.sleep(")
    locality = F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), F.size(diff_files(diff)) - 1) * 0.2)
    return F.struct(locality.alias("locality"), ok.alias("passed"))


def risk_policy(new_security: Column, failing: Column, poc_failed: Column, out_of_scope: Column, process: Column, breaking: Column, blocked: Column) -> Column:
    """struct(risk, action, override): the first rule that holds, else safe and merge_supporting."""

    def out(risk: str, action: str, why) -> Column:
        return F.struct(F.lit(risk).alias("risk"), F.lit(action).alias("action"), (why if isinstance(why, Column) else F.lit(why)).alias("override"))

    return (
        F.when(new_security, out("vulnerability_introducing", "block", "new-security-sarif-alert"))
        .when(failing, out("correct_but_overfit", "block", "failing-required-test"))
        .when(poc_failed, out("vulnerable", "block", "poc-plus-failed"))
        .when(out_of_scope, out("unknown", "block", "out-of-scope-write"))
        .when(process.isin("trace-incomplete", "budget-exhausted", "process-noncompliant"), out("unknown", "review_required", process))
        .when(breaking, out("unknown", "review_required", "breaking-interface-change"))
        .when(blocked, out("unknown", "review_required", "maintainability-gate"))
        .otherwise(out("safe", "merge_supporting", F.lit(None).cast("string")))
    )


def merge_recommendation(action: Column) -> Column:
    return F.when(action == "block", "reject").when(action == "review_required", "needs_human_review").when(action == "merge_supporting", "approve").otherwise("unknown")


OBLIGATION = r"(?i)\b(?:must|shall|should|is required to|is forbidden to)\b"


def normative_clauses(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, clause, atomic): sentences with an obligation; a final one that introduces a list is left out."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    nxt = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    s = lines.withColumn("next", nxt).select("doc_id", "line_no", "next", F.split("line", r"(?<=[.!?])\s+").alias("parts"))
    s = s.select("doc_id", "line_no", "next", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "clause"))
    header = (F.col("pos") == F.col("n") - 1) & F.col("clause").endswith(":") & F.coalesce(F.col("next").rlike(r"^(?:[-*+]|[123]\.)"), F.lit(False))
    low = F.lower("clause")
    return s.where(F.col("clause").rlike(OBLIGATION) & ~header).select("doc_id", "line_no", "pos", "clause", (~(low.contains("and") & F.col("clause").contains(","))).alias("atomic"))


def table_clauses(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, clause): data rows of Markdown tables as 'header: value; ...'."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("island", F.sum(F.when(F.col("line").startswith("|"), 0).otherwise(1)).over(w)).where(F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells).withColumn("sep", F.forall("cells", lambda c: (c == "") | c.rlike("^[-:]+$")))
    v = Window.partitionBy("doc_id", "island").orderBy("line_no")
    rows = rows.withColumn("after", F.max(F.col("sep").cast("int")).over(v.rowsBetween(Window.unboundedPreceding, -1)))
    open_ = F.coalesce(F.col("after"), F.lit(0)) == 0
    rows = rows.withColumn("head", F.last(F.when(open_ & ~F.col("sep"), F.col("cells")), ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0)))
    data = rows.where(~F.col("sep") & ~open_)
    blank = lambda c: c.isin("", "-", "—")
    pairs = F.transform(F.filter(F.arrays_zip(F.col("head").alias("h"), F.col("cells").alias("c")), lambda p: ~blank(p["c"])), lambda p: F.concat(p["h"], F.lit(": "), p["c"]))
    plain = F.filter("cells", lambda c: ~blank(c))
    text = F.array_join(F.when(F.size("head") == F.size("cells"), pairs).otherwise(plain), "; ")
    return data.select("doc_id", "line_no", text.alias("clause")).where("trim(clause) <> ''")


def bullet_clauses(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, clause): bullets that name a symbol or structure and are no obligation or link."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    body = F.trim(F.regexp_extract("line", r"^(?:\s*[-*+]|\s*\d+\.)\s+(.+)$", 1))
    b = lines.withColumn("clause", body).where("length(clause) >= 5")
    link = F.col("clause").rlike(r"^(?:\[[^\]]+\]\([^)]+\)(?:\s+[—-]\s+.+)?|\*\*[^*]+\*\*\s+[—-]\s+.+)$")
    named = F.col("clause").rlike(r"`[A-Za-z_][\w./\-]*`") | F.col("clause").rlike(r"(?i)\b(?:trace|tool|task|server|schema|sarif|resource|repository|register|record|readiness|prompt|phase|persist|notification|mcp|index(?:ing)?|implementation|harness|graph|feature|evidence|emit|contract|clause|capability|audit|architecture|adapter|verdict|workflow)\b")
    return b.where(~link & ~F.col("clause").rlike(OBLIGATION) & named).select("doc_id", "line_no", "clause")


def _has(text: Column, *words: str) -> Column:
    low = F.lower(text)
    c = F.lit(False)
    for w in words:
        c = c | low.contains(w)
    return c


def checkability(text: Column) -> Column:
    return F.when(_has(text, "test", "pytest", "passes", "fails", "performance", "latency", "throughput"), "dynamic").when(_has(text, "security", "secret", "credential", "injection"), "hybrid").otherwise("static")


def risk_class(text: Column) -> Column:
    return F.when(_has(text, "security", "secret", "credential", "injection"), "security").when(_has(text, "compliance", "policy", "governance", "hc"), "compliance").when(_has(text, "performance", "latency"), "performance").otherwise("correctness")


def bounded_snippet(text: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")


def stack_frames(text: Column) -> Column:
    """array of 'file:line' in Python, JavaScript and C++ traces, by line."""
    lines = F.split(text, "\n")
    py = lambda s: F.concat_ws(":", F.nullif(F.regexp_extract(s, r'File "([^"]+)", line (\d+)', 1), F.lit("")), F.nullif(F.regexp_extract(s, r'File "([^"]+)", line (\d+)', 2), F.lit("")))
    js = lambda s: F.concat_ws(":", F.nullif(F.regexp_extract(s, r"\bat .*?\(?([\w./\-]+\.[jt]sx?):(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"\bat .*?\(?([\w./\-]+\.[jt]sx?):(\d+)", 2), F.lit("")))
    cc = lambda s: F.concat_ws(":", F.nullif(F.regexp_extract(s, r"([\w./\-]+\.(?:cpp|cc|hpp|h|c)):(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(s, r"([\w./\-]+\.(?:cpp|cc|hpp|h|c)):(\d+)", 2), F.lit("")))
    one = lambda s: F.coalesce(F.nullif(py(s), F.lit("")), F.nullif(js(s), F.lit("")), F.nullif(cc(s), F.lit("")))
    return F.filter(F.transform(lines, one), lambda x: x.isNotNull())


def issue_files(text: Column) -> Column:
    """Distinct file names mentioned, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w./\-]+\.(?:py|ts|tsx|js|cpp|hpp|java|go|rs|md|json|yaml|yml))\b"), F.lit(1)))


def error_strings(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z]*(?:Error|Exception))\b"), F.lit(1)))


def plain_issue(text: Column) -> Column:
    """An issue's words: links cut to their host, marks of Markdown dropped, white space single, lower case."""
    hosts = F.regexp_replace(text, r"https?://([^/\s]+)\S*", "$1")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(hosts, r"[*_#>`]", " "), r"\s+", " ")))


def issue_symbols(text: Column) -> Column:
    """Dotted names, names in capitals and names with underscores that an issue mentions, each once, in that order of kinds."""
    kinds = (r"\b([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z0-9_.]+)\b", r"\b([A-Z][A-Za-z0-9_]+)", r"\b([a-z]+_[a-z0-9_]+)\b")
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(k), F.lit(1)) for k in kinds)))


def error_lines(text: Column) -> Column:
    """Trimmed lines that tell of an error."""
    return F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x.rlike("(?i)error|exception|panic|sigsegv|null|undefined"))


def issue_sections(issues: DataFrame) -> DataFrame:
    """(issue_id, section, body): what stands under the headings expected, actual, observed and steps, the last one of a name winning. issues: issue_id, text.

    A heading is a line of # or h2. and the word; lines before the first are none.
    """
    lines = issues.select("issue_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    head = F.nullif(F.lower(F.regexp_extract(F.trim("line"), r"(?i)^(?:#+|h2\.)\s*(expected|actual|observed|steps)", 1)), F.lit(""))
    w = Window.partitionBy("issue_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("head", head).withColumn("k", F.count("head").over(w)).withColumn("section", F.last("head", True).over(w)).where("k > 0")
    body = own.groupBy("issue_id", "section", "k").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("n", "line")))), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("body")).where("body <> ''")
    return body.groupBy("issue_id", "section").agg(F.max_by("body", "k").alias("body"))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, without spaces, as UTF-8 and not escaped; null for what is no JSON. Key order has no built-in form."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        import json

        def one(t):
            try:
                return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return canonical(text)


def payload_hash(text: Column) -> Column:
    """24 hex digits of the canonical JSON's SHA-256."""
    return F.substring(F.sha2(canonical_json(text), 256), 1, 24)

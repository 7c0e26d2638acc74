"""Alerts: normalisation, fingerprints, binding, deltas, graph facts (SAR, JON-05..11, FLT-06..08, AGG-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("informational", "low", "medium", "high", "critical")


def ordinal(severity: Column) -> Column:
    """0 for informational to 4 for critical; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)) - 1


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(analyser: Column, rule: Column, path: Column, line: Column, message: Column, snippet: Column | None = None) -> Column:
    """First 16 hex digits over the identifying parts; a line of 0 or null, like a null path, is empty."""
    shot = F.lit("") if snippet is None else F.coalesce(F.substring(F.sha2(squeezed(snippet), 256), 1, 16), F.lit(""))
    parts = [analyser, rule, F.coalesce(path, F.lit("")), F.coalesce(F.nullif(line, F.lit(0)).cast("string"), F.lit("")), squeezed(message), shot]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def partial_fingerprint(family: Column, severity: Column, column: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", family, severity, F.coalesce(F.nullif(column, F.lit(0)).cast("string"), F.lit(""))), 256), 1, 8)


def severity(analyser: Column, level: Column, props: Column) -> Column:
    """One scale from security scores, analyser-specific fields and levels; props is map<string,string>."""
    score = F.coalesce(F.try_to_number(F.coalesce(props["security-severity"], props["security_severity"]), F.lit("999D999")).cast("double"), F.coalesce(props["security-severity"], props["security_severity"]).try_cast("double"))
    raw = F.lower(F.coalesce(level, F.lit("warning")))
    tool = F.lower(analyser)
    sev = F.upper(F.coalesce(props["issue_severity"], props["severity"], raw))
    conf = F.upper(F.coalesce(props["issue_confidence"], props["confidence"], F.lit("")))
    bandit = F.when((sev == "HIGH") & (conf == "HIGH"), "high").when(sev.isin("HIGH", "MEDIUM"), "medium").otherwise("low")
    sonar = F.when(raw == "blocker", "critical").when(raw == "critical", "high").when(raw == "minor", "low").when(raw == "info", "informational").otherwise("medium")
    plain = F.when(raw.isin("error", "high"), "high").when(raw.isin("warning", "medium", "recommendation"), "medium").when(raw.isin("note", "info", "low"), "low").otherwise("informational")
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(tool == "bandit", bandit).when(tool == "sonarqube", sonar).otherwise(plain)


def cwe_ids(*texts: Column) -> Column:
    """Sorted CWE-n of every run of up to five digits; the CWE prefix is optional."""
    text = F.concat_ws("\n", *texts)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,5})"), F.lit(1)), lambda x: x.cast("int"))
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.concat(F.lit("CWE-"), n.cast("string")))


CWE_FAMILIES = {"CWE-89": "sql-injection", "CWE-79": "xss", "CWE-22": "path-traversal", "CWE-78": "command-injection", "CWE-798": "hardcoded-secret", "CWE-327": "crypto-weak", "CWE-476": "null-deref"}
NEEDLES = (("sql-injection", ("sqli", "sql-injection", "sql_injection", "cwe-89")), ("xss", ("xss", "cross-site")), ("path-traversal", ("path-traversal", "directory traversal")), ("command-injection", ("command-injection", "shell")), ("hardcoded-secret", ("hardcoded", "secret", "b105", "password")), ("crypto-weak", ("weak-crypto", "crypto")), ("null-deref", ("null", "nullptr")))


def rule_family(rule: Column, cwes: Column, tags: Column) -> Column:
    """The family of the first known CWE, else of the first needle in rule id and tags, else other."""
    table = F.create_map(*(F.lit(x) for kv in CWE_FAMILIES.items() for x in kv))
    known = F.get(F.filter(F.transform(cwes, lambda c: table[c]), lambda f: f.isNotNull()), F.lit(0))
    hay = F.lower(F.concat_ws(" ", rule, tags))
    found = F.lit("other")
    for family, needles in reversed(NEEDLES):
        found = F.when(F.greatest(*(hay.contains(n).cast("int") for n in needles), F.lit(0)) > 0, family).otherwise(found)
    return F.coalesce(known, found)


def predicate(analyser: Column, rule: Column, props: Column) -> Column:
    return F.when(analyser == "bandit", F.concat(F.lit("BANDIT-"), rule)).when(props["github/alertNumber"].isNotNull(), F.concat(F.lit("GHAS-"), props["github/alertNumber"])).otherwise(rule)


def identified(alerts: DataFrame) -> DataFrame:
    """alerts with fingerprint and alert_id."""
    fp = fingerprint(F.col("analyser_id"), F.col("rule_id"), F.col("file_path"), F.col("start_line"), F.col("message"))
    return alerts.withColumn("fingerprint", fp).withColumn("alert_id", F.concat_ws(":", "analyser_id", "fingerprint"))


def at_least(alerts: DataFrame, least: str) -> DataFrame:
    return alerts.where(ordinal(F.col("severity")) >= SEVERITIES.index(least))


def _one(alerts: DataFrame) -> DataFrame:
    """One row a fingerprint: equal prints differ in severity or suppression only, the least of these stands."""
    w = Window.partitionBy("fingerprint").orderBy("severity", "suppressed", "message")
    return identified(alerts).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def match_leftovers(old: list[tuple], new: list[tuple]) -> list[int]:
    """For each old (line, message), in order, the place of the first unused new one within five lines or with another message, else -1.

    New ones wait by message and by message and line, so each old one looks at few heads and not at all of them.
    """
    from collections import defaultdict, deque
    from heapq import heappop, heappush

    used = [False] * len(new)
    by_message: dict = defaultdict(deque)
    by_line: dict = defaultdict(deque)
    for k, (line, message) in enumerate(new):
        by_message[message].append(k)
        by_line[message, line].append(k)

    def head(queue) -> int | None:
        while queue and used[queue[0]]:
            queue.popleft()
        return queue[0] if queue else None

    heap: list[tuple[int, int]] = []
    names = list(by_message)
    for i, m in enumerate(names):
        heappush(heap, (by_message[m][0], i))

    def first_other(message) -> int | None:
        kept, found = [], None
        while heap:
            k, i = heappop(heap)
            now = head(by_message[names[i]])
            if now is None:
                continue
            if now != k:
                heappush(heap, (now, i))
                continue
            kept.append((k, i))
            if names[i] != message:
                found = k
                break
        for x in kept:
            heappush(heap, x)
        return found

    out = []
    for line, message in old:
        near = [k for d in range(-5, 6) if (message, line + d) in by_line and (k := head(by_line[message, line + d])) is not None]
        other = first_other(message)
        pick = min([*near, *([] if other is None else [other])], default=-1)
        if pick >= 0:
            used[pick] = True
        out.append(pick)
    return out


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """change, alert_id, before_id, change_type of two runs.

    Equal fingerprints are unchanged. What is left is matched within rule and file: each old
    alert, in order of alert_id, takes the first unused new one within five lines or
    with another message. The greedy order matters, so each (rule, file) group of leftovers is
    one Arrow-fed group; everything else is a join.
    """
    b, a = _one(before), _one(after)
    same = a.join(b.select("fingerprint"), "fingerprint", "left_semi").select(F.lit("unchanged").alias("change"), "alert_id", F.col("alert_id").alias("before_id"), F.lit(None).cast("string").alias("change_type"))
    cols = ["rule_id", "file_path", "alert_id", F.coalesce("start_line", F.lit(0)).alias("start_line"), "message", "severity", "suppressed"]
    old = b.join(a.select("fingerprint"), "fingerprint", "left_anti").select(*cols, F.lit(0).alias("side"))
    new = a.join(b.select("fingerprint"), "fingerprint", "left_anti").select(*cols, F.lit(1).alias("side"))

    def greedy(pdf):
        import pandas as pd

        pdf = pdf.sort_values("alert_id")
        olds = list(pdf[pdf.side == 0].itertuples())
        news = list(pdf[pdf.side == 1].itertuples())
        picks = match_leftovers([(o.start_line, o.message) for o in olds], [(c.start_line, c.message) for c in news])
        out = []
        for o, k in zip(olds, picks):
            if k < 0:
                out.append(("disappeared", o.alert_id, o.alert_id, None))
                continue
            pick = news[k]
            kind = "severity_changed" if o.severity != pick.severity else "suppression_changed" if o.suppressed != pick.suppressed else "message_changed" if o.message != pick.message else "location_shifted"
            out.append(("changed", pick.alert_id, o.alert_id, kind))
        taken = set(picks)
        out += [("appeared", c.alert_id, None, None) for k, c in enumerate(news) if k not in taken]
        return pd.DataFrame(out, columns=["change", "alert_id", "before_id", "change_type"])

    rest = old.unionByName(new).groupBy("rule_id", "file_path").applyInPandas(greedy, "change string, alert_id string, before_id string, change_type string")
    return same.unionByName(rest)


def exact_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """change and alert_id on fingerprints alone: unchanged, appeared, disappeared."""
    b, a = _one(before).select("fingerprint", F.col("alert_id").alias("b")), _one(after).select("fingerprint", F.col("alert_id").alias("a"))
    j = b.join(a, "fingerprint", "full_outer")
    return j.select(F.when(F.col("a").isNull(), "disappeared").when(F.col("b").isNull(), "appeared").otherwise("unchanged").alias("change"), F.coalesce("a", "b").alias("alert_id"))


def review_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """new, fixed and severity_changed on (rule, file, line, message); null parts key as 'None'."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in ("rule_id", "file_path", "start_line", "message")))

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(key.alias("key")).agg(F.max(F.lower("severity")).alias(p))

    j = side(before, "b").join(side(after, "a"), "key", "full_outer")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "fixed").when(F.col("a") != F.col("b"), "severity_changed")
    security = F.lower("key").rlike("cwe|injection|taint|xss")
    return j.select("key", change.alias("change"), ((change == "new") & F.col("a").isin("critical", "error")).alias("new_critical"), ((change == "new") & security).alias("new_security")).where("change is not null")


def repair_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys (rule, file, line) gone, per rule, with the number still there and the number new."""
    k = ["rule_id", "file_path", "start_line"]
    b, a = before.select(*k).distinct().withColumn("b", F.lit(1)), after.select(*k).distinct().withColumn("a", F.lit(1))
    return b.join(a, k, "full_outer").groupBy("rule_id").agg(F.count_if(F.col("a").isNull()).alias("gone"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("still"), F.count_if(F.col("b").isNull()).alias("added"))


def bind(alerts: DataFrame, nodes: DataFrame, repo: str) -> DataFrame:
    """Alerts with their first file node, the symbols whose lines they touch, and a grade.

    The range test rides on the equi-join by file, so no nested-loop join is planned.
    """
    own = nodes.where((F.col("repo_id") == repo) & F.col("file_path").isNotNull()).select("node_id", "file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    first = own.groupBy("file_path").agg(F.min("node_id").alias("file_node"))
    line = F.col("start_line")
    hit = alerts.join(own, "file_path").where((line <= F.col("e")) & (line >= F.col("s")))
    symbols = hit.groupBy("alert_id").agg(F.array_sort(F.collect_set("node_id")).alias("symbols"))
    out = alerts.join(first, "file_path", "left").join(symbols, "alert_id", "left")
    grade = F.when(F.col("symbols").isNotNull(), "symbol").when(F.col("file_node").isNotNull(), "file_only").otherwise("unbound")
    return out.select("alert_id", "file_node", F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), grade.alias("grade"))


def file_nodes(alerts: DataFrame, nodes: DataFrame, repo: str) -> DataFrame:
    """(alert_id, file_node): the least file or module node of each alert's file, null where there is none."""
    own = nodes.where((F.col("repo_id") == repo) & F.col("node_type").isin("file", "module")).groupBy("file_path").agg(F.min("node_id").alias("file_node"))
    return alerts.join(own, "file_path", "left").select("alert_id", "file_node")


def graph_facts(bound: DataFrame) -> DataFrame:
    """warned_by edges: first symbol primary, others secondary, without symbols the file node."""
    symbols = bound.select("alert_id", F.posexplode("symbols").alias("pos", "node_id")).select("alert_id", "node_id", F.when(F.col("pos") == 0, "primary").otherwise("secondary").alias("role"))
    files = bound.where("grade = 'file_only'").select("alert_id", F.col("file_node").alias("node_id"), F.lit("file_only").alias("role"))
    return symbols.unionByName(files)


def normalize(logs: DataFrame) -> DataFrame:
    """Flat alerts of the first run of each log. logs: log_id and runs as sources.sarif reads them."""
    run = logs.select("log_id", F.get("runs", F.lit(0)).alias("run"))
    rows = run.select("log_id", F.lower(F.col("run.tool.driver.name")).alias("analyser_id"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    rule = F.get(F.filter("rules", lambda x: x["id"] == F.col("r.ruleId")), F.lit(0))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    flat = rows.select("log_id", "analyser_id", F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"), place["artifactLocation"]["uri"].alias("file_path"), place["region"]["startLine"].alias("start_line"), place["region"]["startColumn"].alias("start_column"), place["region"]["snippet"]["text"].alias("snippet"), F.coalesce(F.size("r.suppressions"), F.lit(0)).alias("n_suppressions"), rule["properties"]["tags"].alias("tags"), F.coalesce(F.col("r.properties"), F.create_map().cast("map<string,string>")).alias("props"))
    flat = flat.withColumn("severity", severity(F.col("analyser_id"), F.col("level"), F.col("props"))).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("cwe_ids", cwe_ids(F.array_join("tags", " ")))
    flat = flat.withColumn("family", rule_family(F.col("rule_id"), F.col("cwe_ids"), F.array_join("tags", " "))).withColumn("suppressed", F.col("n_suppressions") > 0).drop("n_suppressions")
    fp = fingerprint(F.col("analyser_id"), F.col("rule_id"), F.col("file_path"), F.col("start_line"), F.col("message"), F.col("snippet"))
    return flat.withColumn("fingerprint", fp).withColumn("alert_id", F.concat_ws(":", "analyser_id", "fingerprint")).withColumn("partial", partial_fingerprint(F.col("family"), F.col("severity"), F.col("start_column")))


def classify(alerts: DataFrame) -> DataFrame:
    """likely_false_positive for suppressed and test files, needs_review for low severities, else likely_true_positive."""
    fp = F.col("suppressed") | F.coalesce(F.col("file_path").rlike(r"(^|/)tests?/"), F.lit(False))
    return alerts.withColumn("classification", F.when(fp, "likely_false_positive").when(ordinal(F.col("severity")) <= 1, "needs_review").otherwise("likely_true_positive"))


def suppression_proposals(classified: DataFrame) -> DataFrame:
    return classified.where("classification = 'likely_false_positive'")

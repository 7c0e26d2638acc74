"""Readers and writers of evidence: SARIF, coverage, blame, traces, ledgers, manifests (SRC)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.session import numbered

SARIF = """version string, runs array<struct<
 tool:struct<driver:struct<name:string,version:string,rules:array<struct<id:string,name:string,properties:struct<tags:array<string>>>>>>,
 originalUriBaseIds:map<string,struct<uri:string>>,
 results:array<struct<ruleId:string,level:string,message:struct<text:string>,fingerprints:map<string,string>,properties:map<string,string>,suppressions:array<struct<kind:string>>,
  locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:int,endLine:int,startColumn:int,snippet:struct<text:string>>>>>>>>>, _corrupt_record string"""


def read_sarif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(logs, rejected): SARIF 2.1.0 files with their runs; malformed files and other versions are rejected with a reason."""
    raw = spark.read.schema(SARIF).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("log_id", F.input_file_name())
    reason = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.col("version").isNull(), "no version").when(F.col("version") != "2.1.0", "unsupported version").when(F.col("runs").isNull(), "no runs")
    tagged = raw.withColumn("reason", reason)
    return tagged.where("reason is null").select("log_id", "version", "runs"), tagged.where("reason is not null").select("log_id", "reason")


def artifact_path(uri: Column, base: Column, root: str) -> Column:
    """Repository-relative path of an artifact URI: percent-decoded, base and root cut; null outside the root."""
    full = F.when(uri.rlike("^[A-Za-z]+:") | uri.startswith("/"), uri).otherwise(F.concat(F.coalesce(base, F.lit("")), uri))
    plain = F.try_url_decode(F.replace(F.regexp_replace(full, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    r = F.lit(root.rstrip("/") + "/")
    return F.when(plain.startswith(r), F.substring(plain, len(root.rstrip("/")) + 2, 1 << 20)).when(~plain.startswith("/") & ~plain.rlike("^[A-Za-z]+:"), F.regexp_replace(plain, r"^(?:\./)+", ""))


def bandit_to_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Flat alerts of Bandit's own JSON."""
    schema = "results array<struct<test_id:string,test_name:string,filename:string,line_number:int,issue_text:string,issue_severity:string,issue_confidence:string,code:string>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r"))
    return r.select(F.lit("bandit").alias("analyser_id"), F.col("r.test_id").alias("rule_id"), F.col("r.filename").alias("file_path"), F.col("r.line_number").alias("start_line"), F.col("r.issue_text").alias("message"), F.create_map(F.lit("issue_severity"), F.col("r.issue_severity"), F.lit("issue_confidence"), F.col("r.issue_confidence")).alias("props"), F.col("r.code").alias("snippet"))


def read_lcov(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line, hits) of LCOV tracefiles; a record counts only when end_of_record closes it."""
    text = spark.read.text(path, wholetext=True)
    parts = F.split("value", r"(?m)^end_of_record\s*$")
    rec = text.select(F.explode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("rec"))
    rec = rec.select(F.trim(F.regexp_extract("rec", r"(?m)^SF:(.*)$", 1)).alias("file_path"), F.regexp_extract_all("rec", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1)).alias("da")).where("file_path <> ''")
    pair = rec.select("file_path", F.explode("da").alias("d")).select("file_path", F.split("d", ",").alias("p"))
    return pair.select("file_path", F.col("p")[0].cast("int").alias("line"), F.col("p")[1].cast("long").alias("hits"))


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line, hits) of Cobertura XML."""
    schema = "_filename string, lines struct<line:array<struct<_number:int,_hits:bigint>>>"
    raw = spark.read.format("xml").option("rowTag", "class").schema(schema).load(path)
    return raw.select(F.col("_filename").alias("file_path"), F.explode("lines.line").alias("l")).select("file_path", F.col("l._number").alias("line"), F.col("l._hits").alias("hits"))


def parse_blame(texts: DataFrame) -> DataFrame:
    """(file_path, line, commit_sha, author, author_time, summary) of git blame --porcelain texts (file_path, text).

    The header of a commit is given once a file, so a file is read as a whole.
    """

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        head = re.compile(r"^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?$")
        for pdf in parts:
            out = []
            for path, text in zip(pdf["file_path"], pdf["text"]):
                known: dict[str, dict[str, str]] = {}
                sha, line = "", 0
                for row in (text or "").split("\n"):
                    if m := head.match(row):
                        sha, line = m[1], int(m[2])
                        known.setdefault(sha, {})
                    elif row.startswith("\t") and sha:
                        c = known[sha]
                        out.append((path, line, sha, c.get("author"), c.get("author-time"), c.get("summary")))
                    elif sha and " " in row:
                        k, v = row.split(" ", 1)
                        known[sha].setdefault(k, v)
            yield pd.DataFrame(out, columns=["file_path", "line", "commit_sha", "author", "author_time", "summary"])

    return texts.select("file_path", "text").mapInPandas(fn, "file_path string, line int, commit_sha string, author string, author_time string, summary string")


TRACE = "event_id string, event_type string, module string, function string, file_path string, line_number int, depth int, exception string, ts_ns long"


def read_traces(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_traces(events: DataFrame, path: str, order: str = "ts_ns", most: int | None = None) -> None:
    """JSON lines by module and order, all of them; given most, of each module only those within most bytes. truncated tells of a cut."""
    rows = events.withColumn("truncated", F.lit(False))
    if most is not None:
        from lodestone.operators.ledger import byte_cap

        rows = byte_cap(events.withColumn("_json", F.to_json(F.struct(*events.columns))), "module", order, "_json", most).drop("_json")
    rows.repartitionByRange("module", order).sortWithinPartitions("module", order).write.json(path)


def in_scope(module: Column, path: Column, exclude: list[str], include: list[str], stdlib: list[str], third_party: bool = False, keep_stdlib: bool = False) -> Column:
    """Whether a trace event is within a scope: exclusions first, then standard and installed code, then inclusions."""
    hit = lambda words, c: F.greatest(F.lit(0), *(F.coalesce(c.contains(w), F.lit(False)).cast("int") for w in words)) == 1 if words else F.lit(False)
    top = F.substring_index(module, ".", 1)
    return F.when(hit(exclude, module) | hit(exclude, path), False).when(top.isin(*stdlib) if stdlib else F.lit(False), keep_stdlib).when(F.coalesce(path.contains("site-packages"), F.lit(False)), third_party).when(F.lit(not include), True).otherwise(hit(include, module) | hit(include, path))


def export_ledger(records: DataFrame, path: str, sensitive: list[str], date_from: str | None = None, date_to: str | None = None, **equal: str) -> None:
    """Gzipped JSON lines of records between dates with equal fields, without the sensitive columns."""
    out = records
    if date_from:
        out = out.where(F.col("ts") >= F.to_timestamp(F.lit(date_from)))
    if date_to:
        out = out.where(F.col("ts") <= F.to_timestamp(F.lit(date_to)))
    for k, v in equal.items():
        out = out.where(F.col(k) == v)
    out.drop(*sensitive).write.option("compression", "gzip").json(path)


def _digests(size: int):
    """(chunk, rows, sha256, first, text) of runs of lines of a chunk: the digest where the chunk is whole, else its text."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        first, count, held = 0, 0, []

        def run():
            text = "\n".join(held)
            whole = count == size
            return first // size, count, hashlib.sha256(text.encode()).hexdigest() if whole else None, first, None if whole else text

        def table(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["chunk", "rows", "sha256", "first", "text"])

        for b in batches:
            if not b.num_rows:
                continue
            at, out = b.column(0).to_numpy(), []
            # A run ends where a chunk does, or where the next file or part of one goes on elsewhere.
            starts = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (at[1:] % size == 0)])
            ends = np.r_[starts[1:], len(at)]
            lines = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)].astype(np.int32)), b.column(1))
            for lo, hi, text in zip(starts, ends, pc.binary_join(lines, "\n").to_pylist()):
                if held and (at[lo] != first + count or at[lo] % size == 0):
                    out.append(run())
                    held = []
                if not held:
                    first, count = int(at[lo]), 0
                held.append(text)
                count += int(hi - lo)
            if out:
                yield table(out)
        if held:
            yield table([run()])

    return fn


def write_manifest(nodes: DataFrame, edges: DataFrame, path: str, size: int = 1000) -> DataFrame:
    """Node and edge chunks of size rows as gzipped JSON lines, and (kind, chunk, rows, sha256) of each.

    Rows are numbered without a single-task window and shuffled once, to be sorted. A chunk lies in one task, or in
    two where its end is: whole chunks are digested where they are, and only the text of the others is shuffled.
    """
    out = []
    for kind, df, key in (("nodes", nodes, "node_id"), ("edges", edges, "edge_id")):
        json = F.to_json(F.struct(*df.columns))
        rows = numbered(df, kind, [], [key, json], "_k").select(F.floor(F.col("_k") / size).alias("chunk"), "_k", json.alias("json"))
        rows.select("chunk", "json").write.option("compression", "gzip").partitionBy("chunk").text(f"{path}/{kind}")
        runs = rows.select("_k", "json").mapInArrow(_digests(size), "chunk long, rows long, sha256 string, first long, text string")
        parts = F.when(F.col("text").isNotNull(), F.struct("first", "text"))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["text"]), "\n")
        g = runs.groupBy("chunk").agg(F.sum("rows").alias("rows"), F.coalesce(F.max("sha256"), F.sha2(text, 256)).alias("sha256"))
        out.append(g.withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


BUNDLE_VERSION = 1


def save_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet, then the version row that marks a whole bundle."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(BUNDLE_VERSION, ",".join(sorted(tables)))], "version int, tables string").write.parquet(f"{path}/_bundle")


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; other versions are refused."""
    head = spark.read.parquet(f"{path}/_bundle").first()
    if head.version != BUNDLE_VERSION:
        raise ValueError(f"bundle version {head.version}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in head.tables.split(",")}


def read_smoke_suite(spark: SparkSession, root: str) -> DataFrame:
    """(instance, issue fields, gold_files, diff) of an evaluation folder with one sub-folder an instance."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    issue = spark.read.schema("text string, language string, repo_id string, difficulty_tags array<string>, age_days int").option("multiLine", True).json(f"{root}/*/issue.json").withColumn("instance", name)
    gold = spark.read.schema("file_path string, rank int, reason string").option("multiLine", True).json(f"{root}/*/gold_suspects.json").withColumn("instance", name)
    diff = spark.read.text(f"{root}/*/gold_patch.diff", wholetext=True).select(name.alias("instance"), F.col("value").alias("diff"))
    files = gold.groupBy("instance").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file_path"))), lambda x: x["file_path"]).alias("gold_files"))
    return issue.join(files, "instance", "left").join(diff, "instance", "left")


def read_openapi(spark: SparkSession, path: str) -> DataFrame:
    """(route, method, operation_id) of OpenAPI JSON or YAML files; YAML needs the yaml module."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for pdf in parts:
            out = []
            for file, text in zip(pdf["file"], pdf["text"]):
                try:
                    doc = json.loads(text)
                except ValueError:
                    import yaml

                    doc = yaml.safe_load(text)
                for route, ops in (doc.get("paths") or {}).items():
                    for method, op in (ops or {}).items():
                        if method.lower() in ("get", "put", "post", "delete", "patch", "head", "options", "trace"):
                            out.append((file, route, method.upper(), (op or {}).get("operationId")))
            yield pd.DataFrame(out, columns=["file", "route", "method", "operation_id"])

    return texts.mapInPandas(fn, "file string, route string, method string, operation_id string")


def parse_callgrind(texts: DataFrame) -> DataFrame:
    """(trace_id, function, calls, cost): own cost of every function of callgrind outputs (trace_id, text)."""
    lines = texts.select("trace_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("trace_id").orderBy("n")
    fn = F.nullif(F.regexp_extract("line", r"^fn=(?:\(\d+\)\s*)?(.+)$", 1), F.lit(""))
    rows = lines.withColumn("function", F.last(fn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("line").over(w))
    own = rows.where(F.col("line").rlike(r"^[+\-*]?\d* ?\d+ \d+|^\d+ \d+$") & F.col("function").isNotNull())
    called = F.coalesce(F.col("before").startswith("calls="), F.lit(False))
    cost = F.regexp_extract("line", r"(\d+)\s*$", 1).cast("long")
    return own.groupBy("trace_id", "function").agg(F.count_if(called).alias("calls"), F.coalesce(F.sum(F.when(~called, cost)), F.lit(0)).alias("cost"))


CTAGS = "_type string, name string, path string, kind string, line int, end int, scope string, language string"


def read_ctags(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, qualified, kind, line, end) of tags as JSON lines; other rows, and qualified duplicates of a tag, are left out."""
    raw = spark.read.schema(CTAGS).json(path).where("_type = 'tag'")
    own = raw.where(~F.col("name").contains(".") | F.col("scope").isNull())
    return own.select("path", "name", F.concat_ws(".", "scope", "name").alias("qualified"), "kind", "line", F.coalesce("end", "line").alias("end")).distinct()


def sonar_to_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Flat alerts of SonarQube's issue search: (analyser_id, rule_id, file_path, start_line, message, level), levels as SARIF has them."""
    schema = "issues array<struct<rule:string,component:string,line:int,message:string,severity:string>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("issues").alias("r"))
    level = F.when(F.col("r.severity").isin("BLOCKER", "CRITICAL"), "error").when(F.col("r.severity") == "MAJOR", "warning").otherwise("note")
    return r.select(F.lit("sonarqube").alias("analyser_id"), F.col("r.rule").alias("rule_id"), F.substring_index("r.component", ":", -1).alias("file_path"), F.col("r.line").alias("start_line"), F.col("r.message").alias("message"), level.alias("level"))

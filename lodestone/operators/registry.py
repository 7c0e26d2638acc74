"""Index backends, interface plugins and resources by name (EXT-02 to EXT-04, EXT-08, EXT-09).

A backend turns files (repo_id, path, text) into facts (repo_id, path, kind, name); a plugin into contracts
(repo_id, path, role, name). Both are functions from DataFrames to a DataFrame, so a registry only chooses which
plans are put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import contracts as ct
from lodestone.operators import indexers as ix


@dataclass(frozen=True)
class Entry:
    """What is registered: a name, the file endings it reads, what it makes, and how sure that is."""

    name: str
    endings: tuple[str, ...]
    makes: tuple[str, ...]
    confidence: str
    run: Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    entries: dict[str, Entry] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, entry: Entry) -> None:
        """Adds an entry; a name that is taken is refused."""
        if entry.name in self.entries:
            raise ValueError(f"{entry.name} is registered")
        self.entries[entry.name] = entry

    def reload(self, entries: list[Entry], disabled: set[str] = frozenset()) -> tuple[list[str], list[str]]:
        """Replaces all entries; (added, removed) names."""
        old, new = set(self.entries), {e.name for e in entries}
        self.entries, self.disabled = {e.name: e for e in entries}, set(disabled)
        return sorted(new - old), sorted(old - new)

    def active(self) -> list[Entry]:
        return [e for k, e in sorted(self.entries.items()) if k not in self.disabled]

    def for_path(self, path: str) -> list[str]:
        return [e.name for e in self.active() if path.endswith(e.endings)]

    def describe(self, spark: SparkSession) -> DataFrame:
        """(name, endings, makes, confidence, enabled) of every entry."""
        rows = [(e.name, ",".join(e.endings), ",".join(e.makes), e.confidence, k not in self.disabled) for k, e in sorted(self.entries.items())]
        return spark.createDataFrame(rows, "name string, endings string, makes string, confidence string, enabled boolean")

    def run(self, files: DataFrame) -> DataFrame:
        """The rows of all active entries, each over the files with its endings, with backend naming it."""
        out = None
        for e in self.active():
            hit = F.lit(False)
            for end in e.endings:
                hit = hit | F.col("path").endswith(end)
            rows = e.run(files.where(hit)).withColumn("backend", F.lit(e.name))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise ValueError("no active entry")
        return out


def backends() -> Registry:
    """Definitions of Python, TypeScript, C++ and Java files as (repo_id, path, kind, name)."""
    r = Registry()
    facts = lambda f: ix.python_facts(f).where("kind in ('class', 'function', 'method')").select("repo_id", "path", "kind", "name")
    r.register(Entry("python", (".py",), ("class", "function", "method"), "parser", facts))
    for language, endings in (("typescript", (".ts", ".tsx", ".js", ".jsx")), ("cpp", (".c", ".cc", ".cpp", ".cxx", ".h", ".hpp")), ("java", (".java",))):
        r.register(Entry(language, endings, ("class", "function", "import"), "heuristic", lambda f, k=language: ix.regex_symbols(f, k).select("repo_id", "path", "kind", "name")))
    return r


def plugins() -> Registry:
    """Interfaces that files expose or consume as (repo_id, path, role, name)."""
    r = Registry()
    code = (".py", ".ts", ".js", ".cpp", ".h")
    cut = lambda df: df.select("repo_id", "path", "role", "name")
    r.register(Entry("http", code, ("route",), "parser", lambda f: cut(ix.interfaces(f, "http"))))
    r.register(Entry("websocket", code, ("event",), "heuristic", lambda f: cut(ct.socket_events(f))))
    r.register(Entry("zeromq", code, ("endpoint",), "heuristic", lambda f: cut(ct.zeromq_endpoints(f))))
    r.register(Entry("mqtt", code, ("topic",), "heuristic", lambda f: cut(ct.mqtt_topics(f))))
    r.register(Entry("dbus", (".xml", ".py"), ("interface",), "heuristic", lambda f: cut(ct.dbus_interfaces(f))))
    r.register(Entry("idl", (".idl",), ("operation",), "heuristic", lambda f: ct.idl_operations(f).select("repo_id", "path", F.lit("exposes").alias("role"), F.concat_ws(".", "interface", "operation").alias("name"))))
    r.register(Entry("grpc", (".proto",), ("rpc",), "parser", lambda f: ct.proto_rpcs(f).select("repo_id", "path", F.lit("exposes").alias("role"), F.concat_ws("/", "service", "rpc").alias("name"))))
    return r


#: Resources by address: which table, and which columns the parts in braces are equal to.
RESOURCES: Mapping[str, tuple[str, tuple[str, ...]]] = {
    "graph://{repo_id}/nodes/{node_type}": ("nodes", ("node_id", "label", "file_path")),
    "graph://{repo_id}/edges/{edge_type}": ("edges", ("edge_id", "source_id", "target_id", "confidence")),
    "graph://{repo_id}/snapshots/{snapshot_id}": ("nodes", ("node_id", "node_type")),
    "node://{node_id}": ("nodes", ("node_id", "node_type", "label", "qualified_name", "repo_id", "snapshot_id", "file_path")),
    "edge://{edge_id}": ("edges", ("edge_id", "edge_type", "source_id", "target_id", "confidence")),
    "run://{run_id}": ("runs", ("run_id", "status", "workflow", "start_ts", "repo_id")),
    "run://{run_id}/events": ("run_events", ("run_id", "seq", "type", "stage")),
    "runs://{repo_id}/{status}": ("runs", ("run_id", "workflow", "start_ts")),
    "incident://{incident_id}": ("incidents", ("incident_id", "severity", "state")),
    "incident://{incident_id}/runs": ("links", ("run_id",)),
    "alerts://{file_path}": ("alerts", ("rule_id", "start_line", "severity", "message")),
    "artifact://{artifact_id}": ("artifacts", ("artifact_id", "kind", "digest")),
    "artifacts://{repo_id}/{kind}": ("artifacts", ("artifact_id", "run_id")),
    "memory://{trajectory_id}": ("memories", ("trajectory_id", "repo_id", "utility")),
}


def resource(tables: Mapping[str, DataFrame], uri: str) -> DataFrame:
    """What an address names, as rows of its table; of templates that fit the one with fewest parts in braces. An unknown address is refused."""
    fits = []
    for template, (table, columns) in RESOURCES.items():
        pattern = "".join(f"(?P<{x[1:-1]}>{'.+' if template.endswith(x) else '[^/]+'})" if x.startswith("{") else re.escape(x) for x in re.split(r"(\{\w+\})", template) if x)
        if (m := re.fullmatch(pattern, uri)) and table in tables:
            fits.append((len(m.groupdict()), -len(template), template, m.groupdict()))
    if not fits:
        raise ValueError(f"no resource at {uri!r}")
    _, _, template, equal = min(fits, key=lambda x: x[:3])
    table, columns = RESOURCES[template]
    df = tables[table]
    for c, v in equal.items():
        df = df.where(F.col(c).cast("string") == v)
    return df.select(*columns)

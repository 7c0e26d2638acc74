"""Source text to definitions, imports, calls and interfaces (IDX, FUN-08/09). files: repo_id, path, text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import url_path

FACTS = "repo_id string, path string, kind string, name string, qualified string, target string, start_line int, end_line int, def_order int"


def python_facts(files: DataFrame) -> DataFrame:
    """Definitions, imports and calls of Python files by their syntax trees; a file that does not parse yields one 'error' fact."""

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for pdf in parts:
            out = []
            for repo, path, text in zip(pdf["repo_id"], pdf["path"], pdf["text"]):
                module = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".").removeprefix("src.")
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError) as e:
                    out.append((repo, path, "error", type(e).__name__, module, None, getattr(e, "lineno", None) or 0, 0, 0))
                    continue
                out.append((repo, path, "module", module.rsplit(".", 1)[-1], module, None, 1, (text or "").count("\n") + 1, 0))
                order = 0

                def walk(node, scope: list[str], owner: str):
                    nonlocal order
                    for c in ast.iter_child_nodes(node):
                        if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            order += 1
                            kind = "class" if isinstance(c, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                            q = ".".join([module, *scope, c.name])
                            out.append((repo, path, kind, c.name, q, None, c.lineno, c.end_lineno, order))
                            walk(c, [*scope, c.name], owner if kind == "class" else q)
                            continue
                        if isinstance(c, ast.Import):
                            out.extend((repo, path, "import", a.asname or a.name, module, a.name, c.lineno, c.end_lineno, 0) for a in c.names)
                        elif isinstance(c, ast.ImportFrom):
                            base = "." * c.level + (c.module or "")
                            out.extend((repo, path, "import", a.asname or a.name, module, f"{base}:{a.name}", c.lineno, c.end_lineno, 0) for a in c.names)
                        elif isinstance(c, ast.Call):
                            f = c.func
                            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self" else None
                            if name:
                                out.append((repo, path, "call", name, owner, None, c.lineno, c.end_lineno, 0))
                        walk(c, scope, owner)

                walk(tree, [], module)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACTS.split(", ")]).astype({"start_line": "int32", "end_line": "int32", "def_order": "int32"})

    return files.where(F.col("path").endswith(".py")).select("repo_id", "path", "text").mapInPandas(fn, FACTS)


def call_edges(facts: DataFrame) -> DataFrame:
    """(repo_id, path, source, target): calls resolved to the last definition of that name in the file, self-calls left out."""
    defs = facts.where(F.col("kind").isin("function", "method", "class")).groupBy("repo_id", "path", "name").agg(F.max_by("qualified", "def_order").alias("target"))
    calls = facts.where("kind = 'call'").select("repo_id", "path", "name", F.col("qualified").alias("source")).distinct()
    return calls.join(defs, ["repo_id", "path", "name"]).where("source <> target").select("repo_id", "path", "source", "target").distinct()


def imports(facts: DataFrame) -> DataFrame:
    """(repo_id, path, target, status, target_path) of import statements by the files of the repository.

    resolved_internal where a file of the module is there, as folder or file, at the root or under src; relative imports are
    sought from the importing file's folder, a level up for each further dot, and are unresolved where nothing is found. Every other
    absolute import, of the standard library or not, is an external_dependency. The names imported count for nothing.
    target_path is the folder of an __init__.py, else the file.
    """
    i = facts.where("kind = 'import'").select("repo_id", "path", "target").distinct()
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    module = F.replace(F.split_part(F.regexp_replace("target", r"^\.+", ""), F.lit(":"), F.lit(1)), F.lit("."), F.lit("/"))
    i = i.withColumn("dots", dots).withColumn("m", module)
    own = F.split(F.regexp_replace("path", r"\.py$", ""), "/")
    base = F.array_join(F.slice(own, F.lit(1), F.greatest(F.size(own) - F.col("dots"), F.lit(0))), "/")
    near = F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(F.col("m"), F.lit("")))
    package, file = F.lit("/__init__.py"), F.lit(".py")
    sought = F.when(F.col("dots") > 0, F.array(F.concat(near, file), F.concat(near, package))).otherwise(F.array(F.concat("m", package), F.concat("m", file), F.concat(F.lit("src/"), F.col("m"), package), F.concat(F.lit("src/"), F.col("m"), file)))
    asked = i.select("repo_id", "path", "target", F.posexplode(sought).alias("at", "found"))
    hit = asked.join(facts.select("repo_id", F.col("path").alias("found")).distinct(), ["repo_id", "found"]).groupBy("repo_id", "path", "target").agg(F.min_by("found", "at").alias("found"))
    j = i.join(hit, ["repo_id", "path", "target"], "left")
    status = F.when(F.col("found").isNotNull(), "resolved_internal").when((F.col("dots") > 0) | (F.col("m") == ""), "unresolved").otherwise("external_dependency")
    return j.select("repo_id", "path", "target", status.alias("status"), F.regexp_replace("found", r"/__init__\.py$", "").alias("target_path"))


def import_edges(resolved: DataFrame) -> DataFrame:
    """(repo_id, source, target) between the paths of files and what they import inside the repository, each once."""
    return resolved.where("status = 'resolved_internal'").select("repo_id", F.col("path").alias("source"), F.col("target_path").alias("target")).distinct()


def _found(files: DataFrame, kind: str, pattern: str, group: int = 1) -> DataFrame:
    return files.select("repo_id", "path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("name"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PATTERNS: dict[str, tuple[str, dict[str, str]]] = {
    "typescript": (r"\.[jt]sx?$", {"class": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", "function": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "arrow": r"(?m)^\s*(?:export\s+)?const\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>", "interface": r"(?m)^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "import": r"""(?m)^\s*import\b[^'";]*['"]([^'"]+)['"]"""}),
    "cpp": (r"\.(?:c|cc|cpp|cxx|h|hpp)$", {"class": r"(?m)^\s*(?:class|struct)\s+([A-Za-z_]\w*)\s*[:{]", "function": r"(?m)^(?:[A-Za-z_][\w:<>,*&\s]*\s)[*&]?([A-Za-z_][\w:~]*)\s*\([^;{}]*\)\s*(?:const\s*)?\{", "include": r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]"""}),
    "java": (r"\.java$", {"class": r"\bclass\s+([A-Za-z_]\w*)", "interface": r"\binterface\s+([A-Za-z_]\w*)", "method": r"(?m)^\s*(?:public|protected|private)\s+(?:static\s+)?(?:final\s+)?[\w<>\[\],\s]+?\s([a-zA-Z_]\w*)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\{", "import": r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "package": r"(?m)^\s*package\s+([\w.]+)\s*;"}),
    "proto": (r"\.proto$", {"message": r"\bmessage\s+(\w+)", "service": r"\bservice\s+(\w+)", "rpc": r"\brpc\s+(\w+)\s*\("}),
    "idl": (r"\.idl$", {"module": r"\bmodule\s+(\w+)", "interface": r"\binterface\s+(\w+)", "operation": r"(?m)^\s*(?:oneway\s+)?[\w:<>]+\s+(\w+)\s*\([^)]*\)\s*(?:raises\s*\([^)]*\)\s*)?;"}),
}


def regex_symbols(files: DataFrame, language: str) -> DataFrame:
    """(repo_id, path, kind, name) of declarations that a language's patterns find, without leaving the JVM."""
    ext, kinds = PATTERNS[language]
    own = files.where(F.col("path").rlike(ext))
    return _union([_found(own, k, p) for k, p in kinds.items()])


def markdown_headings(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, level, title) outside fenced code."""
    lines = files.where(F.col("path").rlike(r"\.(?:md|markdown)$")).select("repo_id", "path", F.posexplode(F.split("text", "\r?\n")).alias("line", "s"))
    w = Window.partitionBy("repo_id", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fences = F.sum(F.when(F.col("s").rlike(r"^\s*(?:```|~~~)"), 1).otherwise(0)).over(w)
    level = F.length(F.regexp_extract("s", r"^(#{1,6})\s", 1))
    rows = lines.withColumn("_f", fences).withColumn("level", level).where("_f % 2 = 0 and level > 0")
    return rows.select("repo_id", "path", (F.col("line") + 1).alias("line"), "level", F.trim(F.regexp_replace("s", r"^#+\s+|\s+#*\s*$", "")).alias("title"))


INTERFACES: dict[str, tuple[str, str]] = {
    # plugin: (exposing pattern, consuming pattern); the group is what both sides name.
    "http": (r"""@\w+\.(?:get|post|put|delete|patch|route)\(\s*['"]([^'"]+)['"]""", r"""(?:requests|httpx|axios|client)\.(?:get|post|put|delete|patch)\(\s*f?['"`]([^'"`]+)['"`]"""),
    "websocket": (r"""@\w+\.websocket\(\s*['"]([^'"]+)['"]""", r"""(?:new\s+WebSocket|websockets\.connect|ws_connect)\(\s*['"`]([^'"`]+)['"`]"""),
    "grpc": (r"\bclass\s+\w+\((?:\w+\.)?(\w+)Servicer\)", r"\b(?:\w+\.)?(\w+)Stub\("),
    "zeromq": (r"""\.bind\(\s*['"]([^'"]+)['"]""", r"""\.connect\(\s*['"]((?:tcp|ipc|inproc)://[^'"]+)['"]"""),
    "mqtt": (r"""\.publish\(\s*['"]([^'"]+)['"]""", r"""\.subscribe\(\s*['"]([^'"]+)['"]"""),
    "dbus": (r"""BusName\(\s*['"]([^'"]+)['"]""", r"""get_object\(\s*['"]([^'"]+)['"]"""),
    "corba": (r"\bclass\s+\w+\(\w*__?POA\.(\w+)\)", r"\._narrow\((?:\w+\.)?(\w+)\)"),
    "protobuf": (r"(?m)^\s*message\s+(\w+)", r"\b\w+_pb2\.(\w+)\("),
}


def interfaces(files: DataFrame, plugin: str) -> DataFrame:
    """(repo_id, path, plugin, role, name) of what files expose and consume."""
    exposes, consumes = INTERFACES[plugin]
    both = _found(files, "exposes", exposes).unionByName(_found(files, "consumes", consumes))
    name: Column = url_path(F.col("name")) if plugin in ("http", "websocket") else F.col("name")
    return both.select("repo_id", "path", F.lit(plugin).alias("plugin"), F.col("kind").alias("role"), name.alias("name")).distinct()


def interface_links(found: DataFrame) -> DataFrame:
    """(plugin, name, provider, consumer) pairs of files that name the same interface."""
    a = found.where("role = 'exposes'").select("plugin", "name", F.col("path").alias("provider"))
    b = found.where("role = 'consumes'").select("plugin", "name", F.col("path").alias("consumer"))
    return a.join(b, ["plugin", "name"]).where("provider <> consumer")


def incremental(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Facts after an update: old facts stay, keys of changed files that are new are added (existing keys are skipped)."""
    fresh = new.join(changed.select("path"), "path", "left_semi").join(old.select("key"), "key", "left_anti")
    return old.unionByName(fresh.select(*old.columns))

"""Interface contracts and native symbols in source text (IDX-09, IDX-12, IDX-21 to IDX-27, SRC-16, IDX-19). files: repo_id, path, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IDENT = r"[A-Za-z_]\w*"


def _all(text: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def blocks(files: DataFrame, word: str) -> DataFrame:
    """(repo_id, path, name, body) of `word Name [: base] { body }` where the body holds no further block."""
    found = files.select("repo_id", "path", F.explode(_all("text", rf"\b{word}\s+({IDENT}[^{{}};]*\{{[^{{}}]*\}})")).alias("x"))
    return found.select("repo_id", "path", F.regexp_extract("x", rf"^({IDENT})", 1).alias("name"), F.regexp_extract("x", r"(?s)\{(.*)\}", 1).alias("body"))


def idl_operations(files: DataFrame) -> DataFrame:
    """(repo_id, path, interface, operation, returns) of IDL interfaces."""
    b = blocks(files.where(F.col("path").endswith(".idl")), "interface")
    op = b.select("repo_id", "path", F.col("name").alias("interface"), F.explode(_all("body", rf"([\w:]+\s+{IDENT}\s*\([^)]*\))\s*;")).alias("x"))
    return op.select("repo_id", "path", "interface", F.regexp_extract("x", rf"\s({IDENT})\s*\(", 1).alias("operation"), F.regexp_extract("x", r"^([\w:]+)", 1).alias("returns"))


def proto_rpcs(files: DataFrame) -> DataFrame:
    """(repo_id, path, service, rpc, request, response) of services in .proto files."""
    b = blocks(files.where(F.col("path").endswith(".proto")), "service")
    r = b.select("repo_id", "path", F.col("name").alias("service"), F.explode(_all("body", r"\brpc\s+(\w+\s*\([^)]*\)\s*returns\s*\([^)]*\))")).alias("x"))
    part = lambda p: F.trim(F.regexp_extract("x", p, 1))
    return r.select("repo_id", "path", "service", part(r"^(\w+)").alias("rpc"), part(r"^\w+\s*\(([^)]*)\)").alias("request"), part(r"returns\s*\(([^)]*)\)").alias("response"))


def proto_fields(files: DataFrame) -> DataFrame:
    """(repo_id, path, message, field, type, number) of messages in .proto files."""
    b = blocks(files.where(F.col("path").endswith(".proto")), "message")
    f = b.select("repo_id", "path", F.col("name").alias("message"), F.explode(_all("body", r"(\w+\s+\w+\s*=\s*\d+)\s*;")).alias("x"))
    return f.select("repo_id", "path", "message", F.regexp_extract("x", r"\s(\w+)\s*=", 1).alias("field"), F.regexp_extract("x", r"^(\w+)", 1).alias("type"), F.regexp_extract("x", r"(\d+)$", 1).cast("int").alias("number"))


def _named(files: DataFrame, role: str, pattern: str) -> DataFrame:
    return files.select("repo_id", "path", F.lit(role).alias("role"), F.explode(_all("text", pattern)).alias("name")).distinct()


def zeromq_endpoints(files: DataFrame) -> DataFrame:
    """(repo_id, path, role, name): endpoints bound and connected to in files that use the library."""
    own = files.where(F.col("text").rlike(r"import\s+zmq|from\s+zmq\s+import|#include\s+[<\"]zmq"))
    return _named(own, "bind", r"""\.bind\(\s*['"]([^'"]+)['"]""").unionByName(_named(own, "connect", r"""\.connect\(\s*['"]([^'"]+)['"]"""))


def mqtt_topics(files: DataFrame) -> DataFrame:
    """(repo_id, path, role, name): topics published and subscribed to in files that use a client library."""
    own = files.where(F.col("text").rlike(r"(?i)import\s+(?:paho\.)?mqtt|from\s+paho\.mqtt|#include\s+[<\"]mqtt"))
    return _named(own, "publish", r"""(?i)\.publish\(\s*['"]([^'"]+)['"]""").unionByName(_named(own, "subscribe", r"""(?i)\.subscribe\(\s*['"]([^'"]+)['"]"""))


def topic_matches(topic: Column, pattern: Column) -> Column:
    """Whether an MQTT filter matches a topic: + is one level, a final # all that are left, the level before it included."""
    quoted = F.regexp_replace(pattern, r"([.\\\[\](){}*?^$|])", r"\\$1")
    one = F.regexp_replace(quoted, r"(^|/)\+(?=/|$)", "$1[^/]*")
    rest = F.regexp_replace(F.regexp_replace(one, r"/#$", "(?:/.*)?"), "^#$", ".*")
    return F.regexp_like(topic, F.concat(F.lit("^"), rest, F.lit("$")))


def mqtt_links(topics: DataFrame) -> DataFrame:
    """(topic, filter, provider, consumer): publishers and the subscribers whose filters match. Equal names and wildcards go apart, so only wildcards are compared with all topics."""
    a = topics.where("role = 'publish'").select(F.col("name").alias("topic"), F.col("path").alias("provider"))
    b = topics.where("role = 'subscribe'").select(F.col("name").alias("filter"), F.col("path").alias("consumer"))
    wild = F.col("filter").rlike(r"[+#]")
    same = a.join(b.where(~wild), F.col("topic") == F.col("filter"))
    near = a.join(b.where(wild), topic_matches(F.col("topic"), F.col("filter")))
    return same.unionByName(near).select("topic", "filter", "provider", "consumer")


def dbus_interfaces(files: DataFrame) -> DataFrame:
    """(repo_id, path, role, name): interfaces declared in XML and used from Python, and 'interface.method' of the declared."""
    xml = files.where(F.col("path").endswith(".xml"))
    part = xml.select("repo_id", "path", F.explode(_all("text", r"(?s)(<interface\s+name=['\"][^'\"]+['\"].*?</interface>)")).alias("x"))
    part = part.select("repo_id", "path", F.regexp_extract("x", r"name=['\"]([^'\"]+)['\"]", 1).alias("i"), _all("x", r"<method\s+name=['\"]([^'\"]+)['\"]").alias("m"))
    declared = part.select("repo_id", "path", F.lit("declares").alias("role"), F.col("i").alias("name"))
    methods = part.select("repo_id", "path", F.lit("method").alias("role"), F.explode(F.transform("m", lambda m: F.concat_ws(".", "i", m))).alias("name"))
    used = _named(files.where(F.col("path").endswith(".py")), "uses", r"dbus_interface\s*=\s*['\"]([^'\"]+)['\"]")
    return declared.unionByName(methods).unionByName(used).distinct()


def socket_events(files: DataFrame) -> DataFrame:
    """(repo_id, path, role, name): events that servers handle and clients emit or listen to."""
    return _named(files, "handles", r"@(?:\w+\.)?on\(\s*['\"]([^'\"]+)['\"]").unionByName(_named(files, "client", r"\bsocket\.(?:on|emit)\(\s*['\"]([^'\"]+)['\"]"))


#: Words before a parenthesis that call nothing.
NOT_CALLS = ("if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "alignof", "decltype")


def cpp_functions(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, body) of functions defined in C and C++ files; a body ends before the next definition."""
    head = rf"\b(?:{IDENT}[\s:*&]+)+({IDENT})\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{"
    parts = files.where(F.col("path").rlike(r"\.(?:c|cc|cpp|cxx|h|hh|hpp)$")).select("repo_id", "path", _all("text", head).alias("names"), F.split("text", head).alias("bodies"))
    return parts.select("repo_id", "path", F.explode(F.arrays_zip("names", F.slice("bodies", F.lit(2), F.size("names")).alias("bodies"))).alias("x")).select("repo_id", "path", F.col("x.names").alias("name"), F.col("x.bodies").alias("body")).where(~F.col("name").isin(*NOT_CALLS))


def cpp_calls(functions: DataFrame) -> DataFrame:
    """(repo_id, path, caller, callee): calls between functions of one file, each once; a function's calls of itself are left out."""
    made = functions.select("repo_id", "path", F.col("name").alias("caller"), F.explode(F.array_distinct(_all("body", rf"\b({IDENT})\s*\("))).alias("callee"))
    own = functions.select("repo_id", "path", F.col("name").alias("callee")).distinct()
    return made.where("caller <> callee").join(own, ["repo_id", "path", "callee"], "left_semi").select("repo_id", "path", "caller", "callee").distinct()


def build_targets(files: DataFrame) -> DataFrame:
    """(repo_id, path, target, kind, sources) of executables and libraries in CMake files."""
    found = files.where(F.col("path").endswith("CMakeLists.txt")).select("repo_id", "path", F.explode(_all("text", r"(?i)\b(add_(?:executable|library)\s*\([^)]*\))")).alias("x"))
    words = F.filter(F.split(F.trim(F.regexp_extract("x", r"\(([^)]*)\)", 1)), r"\s+"), lambda w: ~w.isin("STATIC", "SHARED", "OBJECT", "MODULE", "WIN32"))
    return found.select("repo_id", "path", words[0].alias("target"), F.when(F.lower("x").startswith("add_exe"), "executable").otherwise("library").alias("kind"), F.array_sort(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).alias("sources"))


def worktree_ids(repos: DataFrame, changed: DataFrame) -> DataFrame:
    """(repo_id, snapshot_id) of dirty worktrees: repos (repo_id, git_sha), changed (repo_id, path, digest; null is missing), the same for any order of files."""
    parts = changed.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.coalesce("digest", F.lit("missing"))))).alias("parts"))
    key = F.concat_ws("|", "repo_id", F.coalesce("git_sha", F.lit("")), F.array_join("parts", "|"))
    return repos.join(parts, "repo_id").select("repo_id", F.concat(F.lit("snap:"), "repo_id", F.lit(":dirty:"), F.substring(F.sha2(key, 256), 1, 16)).alias("snapshot_id"))


def summary_key(repo: Column, symbol: Column, snapshot: Column, digest: Column) -> Column:
    """Id of a cached summary."""
    return F.concat(F.lit("sum:"), F.substring(F.sha2(F.concat_ws("|", repo, symbol, snapshot, digest), 256), 1, 24))


def cached_summaries(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """cache (summary_id, repo_id, file_path) with valid: false where a changed file (repo_id, file_path) makes a summary stale; none is deleted."""
    hit = changed.select("repo_id", "file_path", F.lit(True).alias("_hit")).distinct()
    return cache.join(hit, ["repo_id", "file_path"], "left").withColumn("valid", F.col("_hit").isNull()).drop("_hit")

"""Repository files as tables: walk, classification, hashes, build evidence (SRC-04..06, 33..35, IDX-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "h": "cpp", "c": "c", "java": "java", "go": "go", "rs": "rust", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "proto": "protobuf", "idl": "idl", "sh": "shell", "sql": "sql"}
IGNORED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build", ".mypy_cache", ".tox", "target")
LOCKS = ("package-lock.json", "poetry.lock", "yarn.lock", "Cargo.lock", "uv.lock", "pnpm-lock.yaml")


def classified(files: DataFrame) -> DataFrame:
    """files (path) with language, is_test, is_generated, is_lock, ignored."""
    p = F.col("path")
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    parts = F.split(p, "/")
    return (
        files.withColumn("language", F.coalesce(table[ext], F.lit("unknown")))
        .withColumn("is_test", p.rlike(r"(^|/)tests?/") | name.rlike(r"^test_.*\.py$|_test\.|\.(?:test|spec)\.[jt]sx?$"))
        .withColumn("is_generated", name.rlike(r"_pb2(?:_grpc)?\.py$|\.gen\.|\.min\.js$") | p.rlike("(^|/)generated/"))
        .withColumn("is_lock", name.isin(*LOCKS))
        .withColumn("ignored", F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))))
    )


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length, sha256) of all files under root, path relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root if "://" in root or root.startswith("file:") else "file:" + root
    rel = F.regexp_replace(F.expr("regexp_replace(path, '^file:/+', '/')"), "^" + base.replace("file:", "").rstrip("/").replace("\\", "\\\\").replace(".", r"\.") + "/", "")
    # The scan plans no split for a file without bytes; those come from the listing.
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(base)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    bare = []
    while found.hasNext():
        s = found.next()
        if s.getLen() == 0:
            bare.append((s.getPath().toString(), bytearray(), 0))
    blank = spark.createDataFrame(bare, "path string, content binary, length long")
    return raw.select("path", "content", "length").unionByName(blank).select(rel.alias("path"), "content", "length", F.sha2("content", 256).alias("sha256"))


def folder_nodes(files: DataFrame) -> DataFrame:
    """(path, kind) of files and of each folder above one."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = files.where(F.col("path").contains("/")).select(F.explode(up).alias("path")).distinct().withColumn("kind", F.lit("directory"))
    return files.select("path", F.lit("file").alias("kind")).unionByName(folders)


def contains_edges(nodes: DataFrame) -> DataFrame:
    """(parent, child): each path and the folder it is in; '' is the root."""
    return nodes.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("parent"), F.col("path").alias("child"))


def packages(files: DataFrame) -> DataFrame:
    """Folders that hold an __init__.py."""
    return files.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("package")).distinct()


def build_evidence(files: DataFrame) -> DataFrame:
    """(path, evidence) of build and CI files."""
    n = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.when(n.isin("pyproject.toml", "setup.py", "setup.cfg"), "python").when(n == "package.json", "node").when(n.isin("CMakeLists.txt", "Makefile", "compile_commands.json"), "native").when(n.isin("pom.xml", "build.gradle", "build.gradle.kts"), "java").when(F.col("path").rlike(r"^\.github/workflows/.*\.ya?ml$") | n.isin(".gitlab-ci.yml", "Jenkinsfile"), "ci").when(n.isin("tox.ini", "pytest.ini", "jest.config.js"), "tests")
    return files.select("path", kind.alias("evidence")).where("evidence is not null")


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, includes, defines, standard) of compile_commands.json; arguments win over command."""
    raw = spark.read.schema("directory string, file string, arguments array<string>, command string").option("multiLine", True).json(path)
    args = F.coalesce("arguments", F.split("command", r"\s+"))

    def flag(p: str) -> Column:
        return F.transform(F.filter(args, lambda a: a.startswith(p)), lambda a: F.substring(a, len(p) + 1, 1 << 20))

    return raw.select("directory", "file", flag("-I").alias("includes"), flag("-D").alias("defines"), F.get(flag("-std="), F.lit(0)).alias("standard"))


def package_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, dependency, version, dev) and which test runners a package uses."""
    raw = spark.read.schema("name string, dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>").option("multiLine", True).json(path)
    empty = F.create_map().cast("map<string,string>")
    deps = raw.select("name", F.explode(F.coalesce("dependencies", empty)).alias("dependency", "version"), F.lit(False).alias("dev"))
    dev = raw.select("name", F.explode(F.coalesce("devDependencies", empty)).alias("dependency", "version"), F.lit(True).alias("dev"))
    return deps.unionByName(dev).withColumn("test_runner", F.col("dependency").isin("jest", "mocha", "vitest", "ava", "jasmine"))


def ctest_commands(files: DataFrame) -> DataFrame:
    """(path, test) of add_test calls in CMake files. files: path, text."""
    return files.where(F.col("path").endswith("CMakeLists.txt")).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)add_test\s*\(\s*(?:NAME\s+)?([\w.\-]+)"), F.lit(1))).alias("test"))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two (path, sha256) tables: added, removed, modified."""
    j = old.select("path", F.col("sha256").alias("o")).join(new.select("path", F.col("sha256").alias("n")), "path", "full_outer")
    return j.select("path", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified").alias("change")).where("change is not null")

"""Governance files of repositories: maturity stage, drift, validation (AGG-42/43, FUN-23/24). files: repo_id, path, content."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFEST = "AGENTS.md"
CONTROLS = tuple(f"HC{i}" for i in range(1, 7))
OVERLAYS = ("CLAUDE.md", ".github/copilot-instructions.md", ".codex/INSTRUCTIONS.md")
#: Lines that widen permissions, without case.
WIDENING = (r"allow\s+all", r"no\s+restrictions", r"skip.*hc[1-6]", r"disable.*constraint", r"ignore.*hard\s+constraint")
SKILLS, CI = ".agents/skills/", ".github/workflows/"
GATES: Mapping[str, tuple[str, ...]] = {"S0": (), "S1": ("Makefile",), "S2": ("Makefile", "pyproject.toml", ".pre-commit-config.yaml"), "S3": ("Makefile", "pyproject.toml", ".pre-commit-config.yaml", ".github/workflows", ".secrets.baseline", MANIFEST)}
REQUIRED: Mapping[str, tuple[str, ...]] = {"S0": (MANIFEST,), "S1": (MANIFEST, "CLAUDE.md", ".pre-commit-config.yaml"), "S2": (MANIFEST, "CLAUDE.md", ".pre-commit-config.yaml", ".github/workflows/verify.yml", ".secrets.baseline"), "S3": (MANIFEST, "CLAUDE.md", ".pre-commit-config.yaml", ".github/workflows/verify.yml", ".secrets.baseline", ".github/workflows/governance.yml")}
RELAXING = ("ignore_missing_secrets", "skip_hc", "disable_hc", "no_secrets_scan", "allow_all")
MARKER = "managed-section:auto"


def _there(*names: str) -> Column:
    """Whether a repository has one of the files or folders."""
    p = F.col("path")
    hit = F.lit(False)
    for n in names:
        hit = hit | (p == n) | p.startswith(f"{n}/")
    return F.coalesce(F.bool_or(hit), F.lit(False))


def stages(files: DataFrame) -> DataFrame:
    """(repo_id, stage): S0 to S3 by which files and folders a repository has."""
    c = F.col
    s = files.groupBy("repo_id").agg(_there("src").alias("src"), _there("tests").alias("tests"), _there("Makefile", "makefile").alias("make"), _there("pyproject.toml").alias("project"), _there(".github/workflows", "tox.ini", ".pre-commit-config.yaml").alias("ci"), _there(MANIFEST).alias("manifest"))
    stage = F.when(c("src") & c("tests") & c("make") & c("project") & c("ci") & c("manifest"), "S3").when(c("src") & c("tests") & (c("ci") | c("make") | c("project")), "S2").when(c("src") | c("make") | c("project"), "S1").otherwise("S0")
    return s.select("repo_id", stage.alias("stage"))


_FINDING = ("repo_id", "artefact", "status", "evidence")
_NONE = "array<string>"


def _widening(content: Column) -> Column:
    """'line n: text' of the lines that a pattern of WIDENING hits, pattern by pattern, five at most."""
    lines = F.transform(F.split(content, r"\r\n|\r|\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("x")))

    def hits(pattern: str) -> Column:
        found = F.filter(lines, lambda r: r["x"].rlike(f"(?i){pattern}"))
        return F.transform(found, lambda r: F.concat(F.lit("line "), r["n"].cast("string"), F.lit(": "), F.trim(r["x"])))

    return F.slice(F.concat(*map(hits, WIDENING)), 1, 5)


def drift(files: DataFrame) -> DataFrame:
    """(repo_id, artefact, status, evidence): missing, stale, relaxed or clean for the manifest, overlays, skills and CI of each repository.

    An overlay that is not there is no finding, nor are skills that the manifest does not name.
    """
    repos = files.select("repo_id").distinct()
    manifest = files.where(F.col("path") == MANIFEST).groupBy("repo_id").agg(F.first(F.coalesce("content", F.lit(""))).alias("manifest"))
    base = repos.join(manifest, "repo_id", "left")
    lacks = F.array_compact(F.array(*(F.when(~F.col("manifest").contains(h), h) for h in CONTROLS)))
    own = base.select("repo_id", F.lit(MANIFEST).alias("artefact"), F.when(F.col("manifest").isNull(), "missing").when(F.size(lacks) > 0, "stale").otherwise("clean").alias("status"), F.when(F.col("manifest").isNotNull(), lacks).otherwise(F.array().cast(_NONE)).alias("evidence"))

    text = F.coalesce("content", F.lit(""))
    over = files.where(F.col("path").isin(*OVERLAYS)).join(manifest, "repo_id", "left").withColumn("evidence", _widening(text))
    unaware = (F.coalesce("manifest", F.lit("")) != "") & ~text.contains("HC") & ~F.lower(text).contains("hard constraint") & text.rlike("(?i)allow|deny|permission|tool|mode")
    over = over.select("repo_id", F.col("path").alias("artefact"), F.when(F.size("evidence") > 0, "relaxed").when(unaware, "stale").otherwise("clean").alias("status"), "evidence")

    none = F.array().cast(_NONE).alias("evidence")
    skill = files.where(F.col("path").startswith(SKILLS)).withColumn("name", F.split_part(F.substring("path", len(SKILLS) + 1, 1 << 20), F.lit("/"), F.lit(1))).where(F.length("path") > F.length("name") + len(SKILLS))
    has = skill.groupBy("repo_id", "name").agg(F.bool_or(F.col("path") == F.concat(F.lit(SKILLS), "name", F.lit("/SKILL.md"))).alias("ok"))
    each = has.select("repo_id", F.concat(F.lit(SKILLS), "name", F.lit("/SKILL.md")).alias("artefact"), F.when(F.col("ok"), "clean").otherwise("missing").alias("status"), none)
    named = base.where(F.col("manifest").contains(SKILLS[:-1])).join(files.where(F.col("path").startswith(SKILLS)).select("repo_id"), "repo_id", "left_anti").select("repo_id", F.lit(SKILLS).alias("artefact"), F.lit("missing").alias("status"), none)

    flows = files.where(F.col("path").startswith(CI)).groupBy("repo_id").agg(F.count_if(F.col("path").rlike(r"^\.github/workflows/[^/]+\.ya?ml$")).alias("n"))
    ci = repos.join(flows, "repo_id", "left").select("repo_id", F.lit(CI).alias("artefact"), F.when(F.col("n").isNull(), "missing").when(F.col("n") == 0, "stale").otherwise("clean").alias("status"), none)
    out = own
    for part in (over, each, named, ci):
        out = out.unionByName(part)
    return out.select(*_FINDING)


def required_drift(files: DataFrame, stage: DataFrame, marker: str = MARKER) -> DataFrame:
    """(repo_id, artefact, drift_class) of what a repository's stage (repo_id, stage) requires: missing, relaxed, stale or clean."""
    need = F.coalesce(*(F.when(F.col("stage") == s, F.array(*map(F.lit, a))) for s, a in REQUIRED.items()), F.array(F.lit(MANIFEST)))
    asked = stage.select("repo_id", F.explode(need).alias("artefact"))
    have = files.groupBy("repo_id", F.col("path").alias("artefact")).agg(F.first(F.coalesce("content", F.lit(""))).alias("content"))
    relaxed = F.lit(False)
    for p in RELAXING:
        relaxed = relaxed | F.col("content").contains(p)
    kind = F.when(F.col("content").isNull(), "missing").when(relaxed, "relaxed").when((F.col("artefact") == MANIFEST) & ~F.col("content").contains(marker), "stale").otherwise("clean")
    return asked.join(have, ["repo_id", "artefact"], "left").select("repo_id", "artefact", kind.alias("drift_class"))


def validate(files: DataFrame, scores: DataFrame) -> DataFrame:
    """(repo_id, category, severity, subject): findings of drift, of readiness (scores: repo_id, baseline, current) and of the gates of its stage.

    A repository passes that has no finding of severity error.
    """
    d = drift(files)
    kind = F.when((F.col("status") == "relaxed") | ((F.col("status") == "missing") & (F.col("artefact") == MANIFEST)), "manifest_relaxation").when(F.col("status") == "stale", "drift")
    out = d.select("repo_id", kind.alias("category"), F.when(kind == "drift", "warning").otherwise("error").alias("severity"), F.col("artefact").alias("subject")).where("category is not null")
    known = scores.where("baseline is not null and current is not null")
    out = out.unionByName(known.select("repo_id", F.lit("readiness_regression").alias("category"), F.when(F.col("current") < F.col("baseline"), "error").otherwise("info").alias("severity"), F.lit("readiness").alias("subject")))
    gates = F.coalesce(*(F.when(F.col("stage") == s, F.array(*map(F.lit, g)).cast(_NONE)) for s, g in GATES.items()))
    asked = stages(files).select("repo_id", F.explode(gates).alias("subject"))
    parts = files.select("repo_id", F.split("path", "/").alias("parts"))
    there = parts.select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice("parts", 1, k), "/"))).alias("subject")).distinct()
    gone = asked.join(there, ["repo_id", "subject"], "left_anti")
    return out.unionByName(gone.select("repo_id", F.lit("verify_gate").alias("category"), F.lit("error").alias("severity"), "subject"))

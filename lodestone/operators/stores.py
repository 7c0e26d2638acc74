"""Stores as tables: listing, expiry, deletion, checks (SRC-26 to SRC-30, FLT-10, FLT-25, TOP-06 to TOP-09, EXT-14 to EXT-20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph_store import upsert


def listed(df: DataFrame, order: list[Column], limit: int | None = None, **equal) -> DataFrame:
    """Rows equal to what is given, None being no condition, in an order, limit at most."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def newest(df: DataFrame, ts: str, key: str, limit: int | None = None, **equal) -> DataFrame:
    """listed, the newest first; equal times by key."""
    return listed(df, [F.desc(ts), F.asc(key)], limit, **equal)


def checksum_mismatches(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """(version, stored, expected) of migrations known to both whose checksums differ; versions of one side only pass."""
    j = stored.select("version", F.col("checksum").alias("stored")).join(expected.select("version", F.col("checksum").alias("expected")), "version")
    return j.where("stored <> expected")


def hash_check(artifacts: DataFrame, contents: DataFrame) -> DataFrame:
    """(artifact_id, matched, expected, actual): an artifact without a digest matches, one without content does not."""
    j = artifacts.select("artifact_id", F.col("digest").alias("expected")).join(contents.select("artifact_id", F.col("digest").alias("actual")), "artifact_id", "left")
    blank = F.coalesce("expected", F.lit("")) == ""
    return j.select("artifact_id", F.when(blank, True).otherwise(F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))).alias("matched"), F.when(~blank, F.col("expected")).alias("expected"), F.when(~blank, F.col("actual")).alias("actual"))


def live(as_of: Column) -> Column:
    """Whether a row has not expired: one without expires_ts never does."""
    return F.col("expires_ts").isNull() | (F.col("expires_ts") > as_of)


def cached(cache: DataFrame, asked: DataFrame, as_of: Column) -> DataFrame:
    """asked (cache_key) with hit: whether the cache holds a live row of that key."""
    held = cache.where(live(as_of)).select("cache_key", F.lit(True).alias("hit")).distinct()
    return asked.join(held, "cache_key", "left").select("cache_key", F.coalesce("hit", F.lit(False)).alias("hit"))


def invalidate_file(cache: DataFrame, repo: str, path: str) -> DataFrame:
    """What stays when a file changed; rows without repository or file stay."""
    return cache.where(~F.coalesce((F.col("repo_id") == repo) & (F.col("file_path") == path), F.lit(False)))


def invalidate_stale(cache: DataFrame, repo: str, sha: str) -> DataFrame:
    """What stays when a repository moved to sha."""
    return cache.where(~F.coalesce((F.col("repo_id") == repo) & (F.col("git_sha") != sha), F.lit(False)))


def purge(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(live(as_of))


def cache_stats(cache: DataFrame, lookups: DataFrame, as_of: Column) -> DataFrame:
    """total, valid and stale entries, and the hit rate of lookups (hit), 0 without any."""
    c = cache.agg(F.count("*").alias("total"), F.count_if(live(as_of)).alias("valid")).withColumn("stale", F.col("total") - F.col("valid"))
    h = lookups.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))
    return c.crossJoin(F.broadcast(h))


def without_run(tables: dict[str, DataFrame], run: str, key: str = "run_id") -> dict[str, DataFrame]:
    """Each table without the rows of a run: the run, its rules and its alerts go together."""
    return {k: t.where(~F.coalesce(F.col(key) == run, F.lit(False))) for k, t in tables.items()}


def without_snapshot(df: DataFrame, repo: str, snapshot: str) -> DataFrame:
    """Graph rows without those of a repository's snapshot."""
    return df.where(~F.coalesce((F.col("repo_id") == repo) & (F.col("snapshot_id") == snapshot), F.lit(False)))


def unregister(repos: DataFrame, repo: str) -> DataFrame:
    """The registry without a repository."""
    return repos.where(~F.coalesce(F.col("repo_id") == repo, F.lit(False)))


def current_interfaces(records: DataFrame, plugin: str | None = None) -> DataFrame:
    """Interface records that no other superseded, the last arrival of each id, of a plugin if given."""
    last = upsert(records.limit(0), records, ["interface_id"], "arrival").where(~F.col("superseded"))
    return last.where(F.col("plugin_id") == plugin) if plugin else last


def appended(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A log with new records; one whose key is there already is refused."""
    return have.unionByName(new.join(have.select(key), key, "left_anti").dropDuplicates([key]))


def export_and_delete(records: DataFrame, subject: Column, sensitive: list[str]) -> tuple[DataFrame, DataFrame]:
    """(export, rest) of a privacy request: the subject's rows without sensitive columns, and all other rows."""
    hit = F.coalesce(subject, F.lit(False))
    return records.where(hit).drop(*sensitive), records.where(~hit)


def pending_migrations(known: DataFrame, stored: DataFrame) -> DataFrame:
    """Migrations (version, checksum) that are not stored yet, in the order in which they apply."""
    return known.join(stored.select("version"), "version", "left_anti").orderBy("version")

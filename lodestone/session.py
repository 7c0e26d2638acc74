"""Session helpers shared by every subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when only the driver's sys.path names it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode, where that is unset, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset on {master}: intermediate tables need a folder that all executors share")
        where = getattr(spark, "_lodestone_dir", None)
        if not where:
            where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            spark.sparkContext.setCheckpointDir(where)
            spark._lodestone_dir = where
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read and not a recomputation. Every call writes
    to a folder of its own, so a failed attempt is never read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Free the disk of steps that are done: folders of materialised tables whose readers have all been written out,
    and shuffle files that no plan refers to any more, which else stay until the driver's next full collection."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._lodestone_path)
        path.getFileSystem(hadoop).delete(path, True)
    jvm.System.gc()


def bucketed(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """As materialise, but by a shuffle into n buckets of key, so that grouping by key needs no other one."""
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lodestone/{unique}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(unique)
    out = spark.table(unique)
    # Only the catalogue's entry goes: files of a table with a path stay, and out has been resolved to them.
    out.schema
    spark.sql(f"DROP TABLE {unique}")
    out._lodestone_path = path
    return out


def broadcast_up_to(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if its counted size is within limit; else the join goes another way."""
    return functions.broadcast(df) if df.count() * row_bytes <= limit else df


def numbered(df: DataFrame, name: str, by: list[str], order: list[Column | str], number: str) -> DataFrame:
    """df with number: the place, from 0, of each row in its group of columns by, in the order of order; no group need fit a task.

    Rows are sorted over all tasks and written with their places in a task; where each group begins in each task is then a
    small table, whose running sums travel to the rows.
    """
    first = [functions.col(b).asc_nulls_first() for b in by]
    ends = [o if isinstance(o, Column) else functions.col(o) for o in order]
    rows = materialise(df.repartitionByRange(*first, *ends).sortWithinPartitions(*first, *ends).withColumn("_at", functions.monotonically_increasing_id()), name)
    part = functions.shiftright("_at", 33)
    begins = rows.groupBy(*(functions.col(b).alias(f"_by{i}") for i, b in enumerate(by)), part.alias("_part")).agg(functions.min("_at").alias("_lo"), functions.count("*").alias("_n"))
    before = functions.sum("_n").over(Window.partitionBy(*(f"_by{i}" for i in range(len(by)))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = materialise(begins.select("*", (functions.coalesce(before, functions.lit(0)) - functions.col("_lo")).alias("_shift")).drop("_n", "_lo"), name)
    same = [functions.col(b).eqNullSafe(functions.col(f"_by{i}")) for i, b in enumerate(by)]
    out = rows.join(broadcast_up_to(begins, 64 + 128 * len(by)), [*same, part == functions.col("_part")])
    return out.withColumn(number, functions.col("_at") + functions.col("_shift")).select(*df.columns, number)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

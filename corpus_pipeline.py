"""The corpus pipeline: documents pass a quality filter, near-duplicate removal, benchmark
decontamination, mixing to target weights and sharding. run() applies STAGES in order, each
result written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import chosen_path, ftrl, mixing, sharding, tiling
from lodestone.llm.common import broadcast_if_small, fresh
from lodestone.session import materialise, release, table

#: What a stage but the last returns; other columns of its input are dropped there.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are judged by the bias alone, texts whole, however long; null doc_ids and
    repeated rows are each judged; without labels of both classes all stay. An empty table stays empty.
    """
    return ftrl.filter_docs(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that near-duplicate pairs connect, that of the least doc_id, then of the least hash of its text.

    Rows without a doc_id or a word are in no group and stay. Texts under one doc_id are documents of
    their own, so a different one stays; of rows with the same doc_id and text one stays.
    Texts count whole. An empty table stays empty.
    """
    body = fresh(docs, "body")
    lost = materialise(chosen_path.copies(docs).withColumnRenamed("body", body), "lost")
    rows = docs.withColumn(body, chosen_path.body_hash())
    kept = rows.join(broadcast_if_small(lost, 40), ["doc_id", body], "left_anti")
    again = materialise(rows.where("doc_id is not null").groupBy("doc_id", body).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", body), "again")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    again = broadcast_if_small(again, 40)
    place = fresh(docs, "place")
    first = Window.partitionBy("doc_id", body).orderBy(*(c for c in COLUMNS if c not in ("doc_id", "text")))
    one = kept.join(again, ["doc_id", body], "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return kept.join(again, ["doc_id", body], "left_anti").select(*COLUMNS).unionByName(one.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a benchmark item contaminates.

    Null and empty texts match nothing and stay, as do all with an empty benchmark; null doc_ids and repeated
    rows are each judged, texts whole. An empty table stays empty.
    """
    return tiling.filter_docs(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source documents that meet its token budget.

    A null source is one of its own; null and empty texts have no token and stay; repeated rows are
    documents of their own, ties go by doc_id, texts count whole. An empty table stays empty.
    """
    return mixing.mix(docs).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds region, rack and shard to every row, all its columns kept but those of these names.

    A null doc_id is keyed as a text of its own; repeated rows go to one shard. An empty table stays empty.
    """
    return sharding.shard_docs(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Training, connected components and greedy tiling have no SQL form; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            release(spark, *held)
            held = [docs]
    return docs

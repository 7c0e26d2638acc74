"""Token counts of documents without their token ids.

Texts are split into pre-tokens by the tokenizer's own pattern, JVM-side. The pieces of each
distinct pre-token are counted once. A second pass counts how often each document has each of its
pre-tokens, a batch of documents at a time. Frequent pre-tokens, HOT bytes of them at most and found by
counting, are met there, as their pieces travel with the job; of the many rare ones (document,
pre-token, frequency) goes to meet the rare pieces in a shuffle. A document's count is the sum of
frequency times pieces.

Defined results: null and empty texts have 0 tokens; a null doc_id is a document like others;
repeated rows each get their row; pre-tokens of equal frequency are all sent or none. Texts are counted
whole, however long. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.session import materialise, ship

#: Bytes of pre-tokens, with 16 for each, that travel with the job.
HOT = 8 << 20


def _pieces(raw: bytes):
    @F.pandas_udf("int")
    def pieces(tokens: pd.Series) -> pd.Series:
        encode = bpe.encoding(raw).encode_ordinary
        return pd.Series([len(encode(t)) for t in tokens], dtype="int32")

    return pieces


def _split() -> Column:
    return F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(bpe.JAVA_PATTERN), F.lit(0))


def pretokens(docs: DataFrame, path: str = bpe.PATH) -> DataFrame:
    """(token, freq, pieces) of every distinct pre-token."""
    ship(docs.sparkSession)
    counts = docs.select(F.explode(_split()).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    return counts.withColumn("pieces", _pieces(bpe.ranks(path))("token"))


def cutoff(vocab: DataFrame, hot: int) -> int:
    """The least frequency of pre-tokens that together take no more than hot bytes; frequencies are few, pre-tokens many."""
    reach, least = 0, 1 << 62
    for r in vocab.groupBy("freq").agg(F.sum(F.octet_length("token") + 16).alias("n")).orderBy(F.desc("freq")).toLocalIterator():
        reach += r.n
        if reach > hot:
            break
        least = r.freq
    return least


def _frequencies(tokens: pa.Array, pieces: np.ndarray):
    """Of each row (rid, split, doc_id): the tokens of its frequent pre-tokens as one row with a key of its own, and a row for each rare one."""
    names = ["token", "rid", "doc_id", "n"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, lists = b.column(0).to_numpy(), b.column(1)
            n, ids = len(rid), b.column(2)
            d = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            width = max(1, len(d.dictionary))
            key, freq = np.unique(row * width + d.indices.to_numpy(), return_counts=True)
            row, code = key // width, key % width
            known = pc.index_in(d.dictionary, value_set=tokens).fill_null(-1).to_numpy(zero_copy_only=False)
            at = known[code]
            own = np.bincount(row[at >= 0], freq[at >= 0] * pieces[at[at >= 0]], n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([f"\0{r}" for r in rid.tolist()]), pa.array(rid), ids, pa.array(own)], names)
            rare = at < 0
            if rare.any():
                yield pa.RecordBatch.from_arrays([d.dictionary.take(pa.array(code[rare])), pa.array(rid[row[rare]]), pa.nulls(int(rare.sum()), ids.type), pa.array(freq[rare])], names)

    return fn


def token_counts(docs: DataFrame, path: str = bpe.PATH, hot: int = HOT) -> DataFrame:
    """doc_id and n_tokens for each row of docs."""
    vocab = materialise(pretokens(docs, path), "pretokens")
    least = cutoff(vocab, hot)
    top = vocab.where(F.col("freq") >= least).select("token", "pieces").toArrow().combine_chunks()
    tokens = pa.concat_arrays(top.column("token").chunks) if top.num_rows else pa.array([], pa.string())
    rare = vocab.where(F.col("freq") < least).select("token", "pieces")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), _split().alias("split"), "doc_id")
    counted = rows.mapInArrow(_frequencies(tokens, top.column("pieces").to_numpy().astype(np.int64)), f"token string, rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long")
    # Pre-tokens of a text never begin with NUL and end in a number; rows keyed so carry whole sums and the doc_id.
    met = counted.join(rare.hint("shuffle_merge"), "token", "left")
    return met.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")).select("doc_id", "n_tokens")

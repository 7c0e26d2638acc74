"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal.

Tokens are runs of word characters and runs of marks, case kept. Features are the hashed
unigrams and bigrams; a token that equals one of the two before it adds REPEAT, and
each n-gram seen before in its text adds AGAIN, so repetition is visible whatever the words. A
value is sqrt(count / total), so every vector has length 1. The score of a document is
sigmoid(bias + sparse dot product).

Training uses a bounded sample: of each class at most PER_CLASS labelled documents, those first
in a hash order of doc_id. Scoring covers every document, whole texts.

Defined results: null or empty texts have no feature and score sigmoid(bias) exactly as any
text without evidence does, a null doc_id is scored as any other. Labels that are null, clash
(one doc_id with both) or name no document are left out of training. With no usable label or
just one class, everything scores 1.0 and is kept. Texts are scored whole, however long; a score equal to
the threshold is kept; repeated rows each get their row; an empty table gives no rows. Extra columns, whatever their
names, pass through filter_docs; classify returns doc_id, quality_score, keep only, one row for each input row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WordHash, broadcast_if_small, hash_order, mix, word_hashes
from lodestone.session import ship

BITS = 18
PER_CLASS = 4000
EPOCHS = 3
THRESHOLD = 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
REPEAT, AGAIN = 0, 1


def features(text: str | None, cache: WordHash, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature indices and their values."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    h = word_hashes(tokens, cache)
    with np.errstate(over="ignore"):
        two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    grams = np.concatenate([h, two])
    idx = (grams >> np.uint64(64 - bits)).astype(np.int64)
    idx[idx < 2] += 2
    same = np.count_nonzero(h[1:] == h[:-1]) + np.count_nonzero(h[2:] == h[:-2])
    kinds, counts = np.unique(idx, return_counts=True)
    again = len(grams) - len(kinds)
    head = [(k, c) for k, c in ((REPEAT, same), (AGAIN, again)) if c]
    kinds = np.r_[[k for k, _ in head], kinds].astype(np.int64)
    counts = np.r_[[c for _, c in head], counts].astype(float)
    return kinds, np.sqrt(counts / counts.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal over shuffled rows; examples count inversely to their class's size."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    share = {k: len(rows) / (2 * max(1, sum(r[2] == k for r in rows))) for k in (0, 1)}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            idx, val, y = rows[k]
            i, v = np.r_[idx, bias], np.r_[val, 1.0]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v * share[y]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(bias + 1))
    return w[:bias].astype(np.float32), float(w[bias])


def _extract(bits: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for b in batches:
            idx, val = [], []
            for t in b.column("text"):
                i, v = features(t.as_py(), cache, bits)
                idx.append(i.astype(np.int32).tobytes())
                val.append(v.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["quality", "idx", "val"])

    return fn


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, column, text) of the bounded training sample."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.min(column).cast("int").alias(column), F.max(column).alias("_most")).where(F.col(column) == F.col("_most")).drop("_most")
    parts = [own.where(F.col(column) == k).orderBy(hash_order(11, F.col("doc_id")), "doc_id").limit(per_class) for k in (0, 1)]
    sample = broadcast_if_small(parts[0].unionByName(parts[1]), 16)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(sample, "doc_id").select("doc_id", column, "text")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, bits: int = BITS) -> tuple[np.ndarray, float] | None:
    """The model, or None without documents of both classes."""
    ship(docs.sparkSession)
    got = labelled(docs, labels, "quality", per_class).mapInArrow(_extract(bits), "quality int, idx binary, val binary").collect()
    rows = sorted(((np.frombuffer(r.idx, np.int32).astype(np.int64), np.frombuffer(r.val, np.float32).astype(float), r.quality) for r in got), key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    return train(rows, bits) if len({r[2] for r in rows}) == 2 else None


def score_column(model: tuple[np.ndarray, float] | None, column: str = "text", bits: int = BITS):
    if model is None:
        return F.lit(1.0)
    w, bias = model

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = WordHash()
        for texts in parts:
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                i, v = features(t, cache, bits)
                out[k] = bias + w[i] @ v
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score(F.col(column).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, quality_score and keep for each row of docs."""
    model = fit(docs, labels, per_class)
    scored = docs.select("doc_id", score_column(model).alias("quality_score"))
    return scored.withColumn("keep", F.col("quality_score") >= threshold)


def filter_docs(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns and none else."""
    return docs.where(score_column(fit(docs, labels, per_class)) >= threshold)

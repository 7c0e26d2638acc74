"""What several operators share: words, hashes, grouped Arrow streams and size-checked broadcasts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")

#: A side of a join is broadcast only up to this many bytes, as counted before the join.
BROADCAST_BYTES = 64 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word -> 64-bit hash, each distinct word hashed once while the cache lasts."""

    LIMIT = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        b = word.encode("utf-8", "surrogatepass")
        h = (zlib.crc32(b) << 32) | zlib.crc32(b, 0x5BD1E995)
        self[word] = h
        return h


def word_hashes(words: list[str], cache: WordHash) -> np.ndarray:
    return mix(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of n consecutive word hashes; a shorter text is one n-gram of all its words."""
    n = min(n, len(h))
    if n == 0:
        return h
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = mix(out * _MIX + h[i : len(h) - n + 1 + i])
    return out


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by key: each key is in one table only."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(k, k[-1], "left"))
        if start == 0 and held and held[-1].column(key)[-1].as_py() == k[-1]:
            held.append(t)
            continue
        if start:
            held.append(t.slice(0, start))
        if held:
            yield pa.concat_tables(held)
        held = [t.slice(start)]
    if held:
        yield pa.concat_tables(held)


def spans(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if len(keys):
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        yield from zip(np.r_[0, cut].tolist(), np.r_[cut, len(keys)].tolist())


def keyed(df: DataFrame, key: str, fn: Callable, schema: str, n: int | None = None) -> DataFrame:
    """fn over Arrow batches of partitions that hold whole groups of key, sorted by it."""
    df = df.repartition(n, key) if n else df.repartition(key)
    return df.sortWithinPartitions(key).mapInArrow(fn, schema)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted size is under the limit; else the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not, from name; names are told apart as Spark does, without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hash_order(seed: int, *cols: Column) -> Column:
    """A reproducible pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), *cols)

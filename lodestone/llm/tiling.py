"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words. A benchmark item and a document that share a seed, SEED consecutive
words, are tiled: running Karp-Rabin finds common runs of a search length, the longest
non-overlapping ones are marked first, then the search length shrinks, until SEED. Coverage is
the share of the item's words under tiles, so passages count whose sentences were
reordered or that were cut by insertions. A document is contaminated by an item when coverage
is COVERAGE at least. Items shorter than SEED are sought as one run of all their words.

The benchmark's seeds are broadcast when they are small (counted first); otherwise document
seeds are joined with them by a shuffle. Either way only pairs that share seeds enough for
COVERAGE are tiled, and both give the same rows.

Defined results: null and empty texts and items match nothing, nor does an empty benchmark, and an
empty table of documents gives no rows; texts are tiled whole, however long; equal longest matches
are marked by least start in the item, then in the document; null doc_ids are reported with doc_id
null by find, and dropped by filter_docs if contaminated; repeated rows are each reported; repeated
item_ids each count. Extra columns, whatever their names, are ignored by find, kept by filter_docs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, WORD, WordHash, fresh, mix, ngrams, word_hashes
from lodestone.session import materialise, ship

SEED = 5
COVERAGE = 0.5


def _runs(n: int, h: np.ndarray) -> np.ndarray:
    return ngrams(h, n) if len(h) >= n else np.zeros(0, np.uint64)


def tiles(a: list, b: list, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of greedy string tiles, longest first, ties by least starts."""
    code = {w: i + 1 for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([code[w] for w in a], np.int64), np.array([code[w] for w in b], np.int64)
    free_x, free_y = np.ones(len(x), bool), np.ones(len(y), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(x), len(y)))
    hx, hy = mix(x.astype(np.uint64)), mix(y.astype(np.uint64))
    while size >= least:
        longest = 0
        matches: list[tuple[int, int, int]] = []
        at: dict[int, list[int]] = {}
        for i, k in enumerate(_runs(size, hx).tolist()):
            if free_x[i : i + size].all():
                at.setdefault(k, []).append(i)
        if at:
            ry = _runs(size, hy)
            for j in np.flatnonzero(np.isin(ry, np.fromiter(at, np.uint64, len(at)))).tolist():
                if not free_y[j : j + size].all():
                    continue
                for i in at[int(ry[j])]:
                    k = 0
                    while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k] and free_x[i + k] and free_y[j + k]:
                        k += 1
                    if k >= size:
                        longest = max(longest, k)
                        matches.append((k, i, j))
        if longest > 2 * size:
            size = longest
            continue
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            # A match that a longer tile cut short is found again at a smaller size.
            if free_x[i : i + k].all() and free_y[j : j + k].all():
                free_x[i : i + k] = free_y[j : j + k] = False
                out.append((i, j, k))
        size = size // 2 if size > 2 * least else size - 1
    return out


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text: the one count that seeds, lengths and tiles go by."""
    return WORD.findall(text.lower()) if text else []


def item_seeds(words: list[str], seed: int, cache: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seed hashes of an item and the number of its positions that have each."""
    return np.unique(ngrams(word_hashes(words, cache), seed), return_counts=True)


def least_hits(n: int | np.ndarray, seed: int, coverage: float):
    """Seed positions of an item of n words that tiles of that coverage hold at least.

    A tile of k >= s words holds k - s + 1 positions, and tiles of m words in all hold m / s at
    least, so an item below this cannot be covered: leaving it out loses nothing.
    """
    return coverage * n / np.minimum(seed, n) - 1e-9


class Index:
    """The benchmark: its vocabulary, and its seeds sorted by hash with their items."""

    def __init__(self, items: list[tuple[int, str]], seed: int, coverage: float = COVERAGE):
        self.seed, self.coverage = seed, coverage
        cache = WordHash()
        self.items = [(k, w) for k, t in items if (w := words_of(t))]
        own = [item_seeds(w, seed, cache) for _, w in self.items]
        none = [np.zeros(0, np.uint64)]
        hash_ = np.concatenate([h for h, _ in own] or none)
        order = np.argsort(hash_, kind="stable")
        self.hash = hash_[order]
        self.item = np.repeat(np.arange(len(own)), [len(h) for h, _ in own])[order]
        self.times = np.concatenate([c for _, c in own] or none)[order]
        self.need = least_hits(np.array([len(w) for _, w in self.items], np.int64), seed, coverage) if own else np.zeros(0)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hash >> np.uint64(44)).astype(np.int64)] = True
        self.short = sorted({len(w) for _, w in self.items if len(w) < seed})

    def candidates(self, words: list[str], cache: WordHash) -> list[int]:
        """Items of which words hold seeds enough; a bitmap by leading bits spares most of the searches."""
        if not len(self.hash) or not words:
            return []
        h = word_hashes(words, cache)
        at = []
        for n in [self.seed, *self.short]:
            r = _runs(n, h)
            r = np.unique(r[self.bits[(r >> np.uint64(44)).astype(np.int64)]])
            if len(r):
                lo, hi = np.searchsorted(self.hash, r, "left"), np.searchsorted(self.hash, r, "right")
                at += [np.arange(lo[k], hi[k]) for k in np.flatnonzero(hi > lo).tolist()]
        if not at:
            return []
        at = np.concatenate(at)
        which, inv = np.unique(self.item[at], return_inverse=True)
        return which[np.bincount(inv, self.times[at]) >= self.need[which]].tolist()

    def match(self, words: list[str], cache: WordHash) -> list[tuple[int, float]]:
        """(item_id, coverage) of the items that contaminate these words."""
        out = []
        for i in self.candidates(words, cache):
            k, item = self.items[i]
            got = cover(item, words, self.seed)
            if got >= self.coverage:
                out.append((k, got))
        return out


def cover(item: list[str], words: list[str], seed: int) -> float:
    """Share of item's words under tiles. Words foreign to the item only part its runs, so a stretch of them is one mark."""
    mine = set(item)
    near: list = []
    for w in words:
        if w in mine:
            near.append(w)
        elif near and near[-1] is not None:
            near.append(None)
    return sum(k for _, _, k in tiles(item, near, min(seed, len(item)))) / len(item)


def _find(index: Index):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for b in batches:
            doc, item, got = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                for k, c in index.match(words_of(t.as_py()), cache):
                    doc.append(d)
                    item.append(k)
                    got.append(c)
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(got, pa.float64())], ["doc_id", "item_id", "coverage"])

    return fn


def _seeds_of_items(seed: int):
    """(iid, n, seed, times) of items: words of the item, and its seeds with their numbers of positions."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = words_of(t.as_py())
                if words:
                    h, times = item_seeds(words, seed, cache)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d, np.int64)), pa.array(np.full(len(h), len(words), np.int32)), pa.array(h.view(np.int64)), pa.array(times)], ["iid", "n", "seed", "times"])

    return fn


def _seeds_of_docs(lengths: list[int]):
    """(rid, seed): the distinct n-grams of those lengths in each text."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for b in batches:
            row, out = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                h = word_hashes(words_of(t.as_py()), cache)
                own = np.unique(np.concatenate([_runs(n, h) for n in lengths])).view(np.int64)
                row.append(np.full(len(own), d, np.int64))
                out.append(own)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(row)), pa.array(np.concatenate(out))], ["rid", "seed"])

    return fn


def _benchmark(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _small(items: DataFrame, limit: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0) * 16 <= limit


def _joined(texts: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """texts (rid, doc_id, text) against a benchmark of any size: seeds meet by a shuffle, then texts and items by id.

    Only pairs with seeds enough, least_hits, carry their texts.
    """
    items = materialise(items.withColumn("iid", F.monotonically_increasing_id()), "items")
    right = materialise(items.select("iid", "text").mapInArrow(_seeds_of_items(seed), "iid long, n int, seed long, times long"), "seeds")
    # Shorter lengths than seed are there for items of so few words; only lengths that occur are made.
    lengths = sorted({seed} | {r.n for r in right.where(F.col("n") < seed).select("n").distinct().collect()})
    left = texts.select("rid", "text").mapInArrow(_seeds_of_docs(lengths), "rid long, seed long")
    hits = left.join(right, "seed").groupBy("rid", "iid").agg(F.sum("times").alias("hits"), F.first("n").alias("n"))
    n = F.col("n")
    pairs = materialise(hits.where(F.col("hits") >= coverage * n / F.least(n, F.lit(seed)) - 1e-9).select("rid", "iid"), "pairs")

    @F.pandas_udf("double")
    def covered(item: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([cover(words_of(x), words_of(t), seed) for x, t in zip(item, text)], dtype=float)

    both = pairs.join(texts, "rid").join(items.select("iid", "item_id", F.col("text").alias("item")), "iid")
    return both.select("rid", "doc_id", "item_id", covered("item", "text").alias("coverage")).where(F.col("coverage") >= coverage)


def find(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, coverage of every document that an item contaminates."""
    ship(docs.sparkSession)
    items = _benchmark(benchmark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if _small(items, limit):
        index = Index([(r.item_id, r.text) for r in items.collect()], seed, coverage)
        return texts.mapInArrow(_find(index), "doc_id long, item_id long, coverage double")
    rows = materialise(texts.withColumn("rid", F.monotonically_increasing_id()), "texts")
    return _joined(rows, items, seed, coverage).select("doc_id", "item_id", "coverage")


def filter_docs(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    ship(docs.sparkSession)
    items = _benchmark(benchmark)
    if _small(items, limit):
        index = Index([(r.item_id, r.text) for r in items.collect()], seed, coverage)

        @F.pandas_udf("boolean")
        def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache = WordHash()
            for texts in parts:
                yield pd.Series([not index.match(words_of(t), cache) for t in texts], dtype=bool)

        return docs.where(clean(F.col("text").cast("string")))
    rid = fresh(docs, "rid")
    rows = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "texts")
    texts = rows.select(F.col(rid).alias("rid"), "doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    bad = _joined(texts, items, seed, coverage).select(F.col("rid").alias(rid)).distinct()
    return rows.join(bad, rid, "left_anti").select(*docs.columns)

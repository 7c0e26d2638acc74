"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is SEEDS plus what labels teach: words and word beginnings that are far more frequent in
toxic training documents than in others (share LIFT times as large, log-likelihood ratio LEAST_G);
those STRONG times as frequent form the strong lexicon, all of them the wide one. Near copies in the
sample count once, so that a much-copied document teaches nothing. Features, all JVM-side:
strong and wide hits in all and in a thousand words, hits with a second-person pronoun
within three words, obfuscated hits (letters swapped for look-alikes or parted by marks), swapped
look-alikes inside any word, capitals, exclamation and question marks, other marks, and words.

Trees are grown on histograms with logistic loss on one part of a bounded sample of labelled
documents (PER_CLASS a class at most), and calibrated on the other part by pool-adjacent-violators.

Defined results: null and empty texts have no feature and toxic is False for them; null doc_ids
and repeated rows each get their row; with no usable label or one class only, a document is toxic
iff it has a hit of SEEDS (probability 1 or 0). Texts count whole, however long; an empty table gives no rows.
Extra columns are ignored. Ties in splits go to the first feature, then to the least threshold.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import hash_order
from lodestone.llm.ftrl import labelled
from lodestone.session import materialise, ship

SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "disgusting", "worthless", "clown", "imbecile", "dumbass", "bastard", "bitch", "asshole", "retard", "vermin", "filth")
SECOND = ("you", "your", "yours", "yourself", "ur", "du", "dich", "dir", "dein", "deine", "tu", "toi", "te", "ton", "ta", "vous", "votre", "vos", "tú", "ti", "usted", "vosotros")
PER_CLASS = 4000
LIFT, STRONG = 6.0, 20.0
LEAST_G = 15.0
LEAST_DOCS = 4
BEGINS = (4, 5, 6, 7)
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32

FEATURES = ["hits", "hit_rate", "wide_hits", "wide_rate", "second_person", "obfuscated", "swapped_rate", "capital_share", "loud_rate", "mark_share", "n_words"]

_SWAP = {"a": "a4@", "e": "e3", "i": "i1!|", "o": "o0", "s": "s5$", "t": "t7+", "l": "l1|", "g": "g9", "b": "b8"}


def _any(words: list[str]) -> str:
    """Alternation of words, grouped by first letter so that a mismatch is found at once."""
    by: dict[str, list[str]] = {}
    for w in sorted(words, key=lambda w: (-len(w), w)):
        by.setdefault(w[:1], []).append(re.escape(w[1:]))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by.items()))


def lexicon_pattern(words: list[str], begins: list[str]) -> str:
    """Whole words, and words with one of the beginnings."""
    parts = ([f"(?:{_any(words)})(?![\\p{{L}}\\p{{N}}])"] if words else []) + ([f"(?:{_any(begins)})"] if begins else [])
    return f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(parts)})" if parts else "(?!)"


def obfuscated_pattern(words: list[str], begins: list[str] = []) -> str:
    """The words, and longer words with one of the beginnings, with look-alikes or marks between letters, and not as they are.

    The look-ahead for a sign after letters only spares plain words the alternation.
    """
    long = [w for w in words if len(w) >= 4]
    if not long and not begins:
        return "(?!)"

    def shapes(of: list[str]) -> str:
        return "|".join("[._*\\-]?".join(f"[{re.escape(_SWAP[c])}]" if c in _SWAP else re.escape(c) for c in w) for w in sorted(of))

    parts = [f"(?!(?:{_any(long)})(?![\\p{{L}}\\p{{N}}]))(?:{shapes(long)})(?![\\p{{L}}\\p{{N}}])"] if long else []
    parts += [f"(?!(?:{_any(begins)}))(?:{shapes(begins)})(?:[._*\\-]?\\p{{L}})+"] if begins else []
    return f"(?<![\\p{{L}}\\p{{N}}])(?=\\p{{L}}*[^\\p{{L}}\\s])(?:{'|'.join(parts)})"


def features(words: list[str], begins: list[str], hidden: list[str]) -> dict[str, Column]:
    """Feature columns of low, the lower-cased text, and text; hidden are the words looked for in disguise."""
    low, text = F.col("low"), F.col("body")
    lex = lexicon_pattern(words, begins)
    person = f"(?<![\\p{{L}}])(?:{_any(list(SECOND))})(?![\\p{{L}}])"
    gap = "(?:[^\\p{L}\\p{N}]+[\\p{L}\\p{N}]+){0,3}[^\\p{L}\\p{N}]+"
    near = f"{person}{gap}{lex}|{lex}[\\p{{L}}]*{gap}{person}"

    def count(pattern: str, of: Column) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    n = F.greatest(F.length(text).cast("double"), F.lit(1.0))
    k = F.greatest(F.col("words").cast("double"), F.lit(1.0))
    hits = F.col("hits")
    return {
        "hits": hits,
        "hit_rate": hits * 1000 / k,
        "wide_hits": F.col("wide"),
        "wide_rate": F.col("wide") * 1000 / k,
        "second_person": F.when(hits > 0, count(near, low)).otherwise(0.0),
        "obfuscated": count(obfuscated_pattern(hidden, begins), low),
        "swapped_rate": count("(?<=\\p{L})[0134578@$](?=\\p{L})", low) * 1000 / k,
        "capital_share": (n - F.length(F.regexp_replace(text, "\\p{Lu}+", ""))) / n,
        "loud_rate": count("[!?]+", text) * 1000 / k,
        "mark_share": (n - F.length(F.regexp_replace(text, "[^\\p{L}\\p{N}\\s]+", ""))) / n,
        "n_words": F.col("words").cast("double"),
    }


def with_features(df: DataFrame, words: list[str], begins: list[str], wide: list[str], hidden: list[str], *keep: str) -> DataFrame:
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = df.select(*keep, body.alias("body"), F.lower(body).alias("low"), F.regexp_count(body, F.lit(r"\S+")).alias("words"))
    base = base.withColumn("hits", F.regexp_count("low", F.lit(lexicon_pattern(words, begins))).cast("double"))
    base = base.withColumn("wide", (F.regexp_count("low", F.lit(lexicon_pattern([], wide))).cast("double") if wide else F.lit(0.0)) + F.col("hits"))
    return base.select(*keep, *(e.alias(k) for k, e in features(words, begins, hidden).items()))


def distinct_sample(sample: DataFrame) -> DataFrame:
    """sample with one of each set of near copies: rows that share one of three pairs of minhashes of word 5-grams."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    out = sample.withColumn("_w", words)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 4, F.lit(1))), lambda i: F.xxhash64(F.slice("_w", i, F.lit(5))))
    least = lambda k: F.array_min(F.transform("_g", lambda h: F.xxhash64(F.lit(k), h)))
    out = out.withColumn("_g", grams).select("doc_id", "toxic", "text", *(F.xxhash64(least(2 * k), least(2 * k + 1)).alias(f"_m{k}") for k in range(3)))
    for k in range(3):
        first = Window.partitionBy("toxic", f"_m{k}").orderBy("doc_id", "text")
        out = out.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    return out.select("doc_id", "toxic", "text")


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str], list[str], list[str]]:
    """(words, beginnings, wide beginnings, words in disguise) that mark the toxic documents of sample (toxic, text).

    Words that have a beginning are left out of the words, as they are hits anyhow, but not out of those in disguise.
    """
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0)))
    keys = F.transform(found, lambda w: F.concat(F.lit("w"), w))

    def begun(n: int) -> Column:
        longer = F.filter(found, lambda w: F.length(w) > n)
        return F.array_distinct(F.transform(longer, lambda w: F.concat(F.lit("b"), F.substring(w, 1, n))))

    keys = F.concat(keys, *map(begun, BEGINS))
    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return sorted(SEEDS), [], [], sorted(SEEDS)
    df = sample.select("toxic", F.explode(keys).alias("key")).groupBy("key").agg(F.sum("toxic").cast("double").alias("t"), F.count("*").cast("double").alias("n"))
    c, share = F.col("n") - F.col("t"), n1 / (n1 + n0)
    rate = (F.col("t") / n1) / ((c + 0.5) / n0)
    g = 2 * (F.col("t") * F.log(F.col("t") / (F.col("n") * share)) + F.when(c > 0, c * F.log(c / (F.col("n") * (1 - share)))).otherwise(0.0))
    good = df.where((F.col("t") >= LEAST_DOCS) & (rate >= LIFT) & (g >= LEAST_G)).select("key", (rate >= STRONG).alias("strong")).collect()

    def shortest(keys: list[str]) -> list[str]:
        out: list[str] = []
        for k in sorted(keys, key=lambda k: (len(k), k)):
            if not k.startswith(tuple(out)):
                out.append(k)
        return sorted(out)

    begins = shortest([r.key[1:] for r in good if r.key[0] == "b" and r.strong])
    wide = [k for k in shortest([r.key[1:] for r in good if r.key[0] == "b"]) if k not in begins]
    words = {*SEEDS, *(r.key[1:] for r in good if r.key[0] == "w" and r.strong)}
    return sorted(w for w in words if not w.startswith(tuple(begins))), begins, wide, sorted(words)


class Trees:
    """Boosted trees of fixed depth: per level and node a feature and a threshold, values in the leaves."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of logistic loss over histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(x), base)
    features, thresholds, values = [], [], []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-raw))
        g, h = q - y, q * (1 - q)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            if len(rows) >= 20:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(x.shape[1]):
                    m = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], m))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], m))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, j], minlength=m))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < 5) | (len(rows) - nl < 5)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best + 1e-12:
                        best, f[node], c[node] = gain[k], j, cuts[j][k]
            at[rows] = 2 * node + 1 + (x[rows, f[node]] > c[node])
        leaf = at - inner
        gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        v = -RATE * gs / (hs + 1)
        raw += v[leaf]
        features.append(f)
        thresholds.append(c)
        values.append(v)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: rising scores and the probability at each, to be interpolated."""
    at, inv = np.unique(score, return_inverse=True)
    n, s = np.bincount(inv).astype(float), np.bincount(inv, y)
    blocks: list[list[float]] = []
    for k in range(len(at)):
        blocks.append([s[k], n[k], k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1][0] += b[0]
            blocks[-1][1] += b[1]
    xs, ps, start = [], [], 0
    edges = [int(b[2]) for b in blocks[1:]] + [len(at)]
    for b, e in zip(blocks, edges):
        xs += [at[start], at[e - 1]]
        ps += [b[0] / b[1]] * 2
        start = e
    return np.array(xs), np.array(ps)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """((words, beginnings, wide beginnings, words in disguise), trees, calibration); trees are None without labels of both classes."""
    ship(docs.sparkSession)
    sample = materialise(distinct_sample(labelled(docs, labels, "toxic", per_class)), "sample")
    lexicon = learn_lexicon(sample)
    rows = with_features(sample, *lexicon, "doc_id", "toxic").orderBy(hash_order(11, F.col("doc_id")), "doc_id", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r.toxic for r in rows], float)
    part = np.arange(len(y)) % 4 == 3
    if len(set(y[~part])) < 2 or len(set(y[part])) < 2:
        return lexicon, None, None
    trees = boost(x[~part], y[~part])
    return lexicon, trees, isotonic(trees.raw(x[part]), y[part])


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, probability, toxic for each row of docs."""
    lexicon, trees, calibration = model
    rows = with_features(docs, *lexicon, "doc_id")
    if trees is None:
        p = F.when(F.col("hits") > 0, 1.0).otherwise(0.0)
    else:

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(float) for c in columns], 1)
            return pd.Series(np.interp(trees.raw(x), *calibration))

        p = F.when(F.col("n_words") > 0, probability(*(F.col(f) for f in FEATURES))).otherwise(0.0)
    return rows.select("doc_id", p.alias("probability")).withColumn("toxic", F.col("probability") >= threshold)


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    return score(docs, fit(docs, labels, per_class), threshold)

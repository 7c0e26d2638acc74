"""Quality rules: an ordered decision list learned by sequential covering.

Statistics of a text are built-in column expressions. From labelled statistics, rules for
the rejecting class are grown one at a time: a conjunction of thresholds gets the condition of
greatest FOIL gain until it covers no good document of the growing part, then loses final
conditions while that raises (p - n) / (p + n) on the pruning part. Documents under the rule are
removed and the next is grown, until a rule is less than PRECISION pure on the pruning part
or covers fewer than SUPPORT bad documents. The list becomes one CASE expression,
first match wins, so scoring runs inside generated code.

Training uses a bounded sample, at most PER_CLASS labelled documents a class. The list is applied
to every document, whole texts.

Defined results: null and blank texts have all statistics 0 and are judged by the list like
others; with no usable label or one class only, the list is empty and all are kept. Null
doc_ids and repeated rows each get their row. Extra columns are ignored. Labels that are null or
clash are left out. Texts count whole, however long. Ties between conditions go to the first statistic, then to the least threshold.
An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hash_order
from lodestone.llm.ftrl import labelled
from lodestone.session import ship

PER_CLASS = 5000
PRECISION = 0.9
SUPPORT = 5
MOST_CONDITIONS = 4
MOST_RULES = 12
#: Candidate thresholds of a statistic: this many quantiles.
CUTS = 64

STATS = ["n_chars", "n_words", "word_length", "distinct_share", "mark_share", "capital_share", "digit_share", "lines", "line_share", "repeat_share"]


def with_statistics(df: DataFrame, *keep: str) -> DataFrame:
    """keep and all statistics; each is 0 for texts without words.

    The arrays are columns of a projection of their own: inside a lambda, an expression would be
    made again for every element.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body, words, lines = F.col("_t"), F.col("_w"), F.col("_l")
    base = df.select(*keep, t.alias("_t"))
    base = base.select(*keep, "_t", F.filter(F.split(body, r"\s+"), lambda w: w != "").alias("_w"), F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "").alias("_l"))
    n = F.length(body).cast("double")
    k = F.size(words).cast("double")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def without(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(body, pattern, ""))

    pairs = F.zip_with(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: a == b)
    return base.select(
        *keep,
        n.alias("n_chars"),
        k.alias("n_words"),
        share(F.length(F.array_join(words, "")).cast("double"), k).alias("word_length"),
        share(F.size(F.array_distinct(words)).cast("double"), k).alias("distinct_share"),
        share(without(r"[^\p{L}\p{N}\s]+"), n).alias("mark_share"),
        share(without(r"\p{Lu}+"), n).alias("capital_share"),
        share(without(r"\p{N}+"), n).alias("digit_share"),
        F.size(lines).cast("double").alias("lines"),
        share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")).alias("line_share"),
        share(F.size(F.filter(pairs, lambda x: x)).cast("double"), k).alias("repeat_share"),
    )


@dataclass(frozen=True)
class Rule:
    """All of (statistic, '<=' or '>', threshold) hold."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self) -> Column:
        c = F.lit(True)
        for name, op, x in self.terms:
            c = c & (F.col(name) <= x if op == "<=" else F.col(name) > x)
        return c

    def mask(self, x: np.ndarray, names: list[str] = STATS) -> np.ndarray:
        m = np.ones(len(x), bool)
        for name, op, cut in self.terms:
            v = x[:, names.index(name)]
            m &= v <= cut if op == "<=" else v > cut
        return m


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[tuple[str, str, float]]:
    terms: list[tuple[str, str, float]] = []
    inside = np.ones(len(x), bool)
    while len(terms) < MOST_CONDITIONS:
        p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
        if n0 == 0 or p0 == 0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for f, name in enumerate(names):
            v = x[inside, f]
            b = bad[inside]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS), method="lower"))
            order = np.argsort(v, kind="stable")
            sv, cum = v[order], np.r_[0, np.cumsum(b[order])]
            for cut in cuts:
                k = int(np.searchsorted(sv, cut, "right"))
                for op, p, n in (("<=", cum[k], k - cum[k]), (">", p0 - cum[k], (p0 + n0 - k) - (p0 - cum[k]))):
                    if p:
                        gain = p * (np.log2(p / (p + n)) - base)
                        if gain > best[0] + 1e-12:
                            best = (gain, (name, op, float(cut)), None)
        if best[1] is None:
            break
        terms.append(best[1])
        inside &= Rule((best[1],)).mask(x, names)
    return terms


def learn(x: np.ndarray, bad: np.ndarray, names: list[str] = STATS, seed: int = 5) -> list[Rule]:
    """The ordered rules that reject; x has a column for each of names."""
    rng = np.random.default_rng(seed)
    grow = rng.random(len(x)) < 2 / 3
    out: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(out) < MOST_RULES and (left & bad & grow).any():
        terms = _grow(x[left & grow], bad[left & grow], names)
        if not terms:
            break

        def worth(k: int, at: np.ndarray) -> tuple[float, int, int]:
            m = Rule(tuple(terms[:k])).mask(x, names) & at
            p, n = int((m & bad).sum()), int((m & ~bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        k = max(range(1, len(terms) + 1), key=lambda k: (worth(k, left & ~grow)[0], -k))
        _, p, n = worth(k, left)
        _, pp, pn = worth(k, left & ~grow)
        if p < SUPPORT or p < PRECISION * (p + n) or (pp + pn and pp < PRECISION * (pp + pn)):
            break
        rule = Rule(tuple(terms[:k]))
        out.append(rule)
        left &= ~rule.mask(x, names)
    return out


def decision(rules: list[Rule]) -> Column:
    """Number of the first rule that matches, from 1; 0 for none."""
    c = F.when(F.lit(False), F.lit(0))
    for i, r in enumerate(rules, 1):
        c = c.when(r.column(), F.lit(i))
    return c.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    ship(docs.sparkSession)
    rows = with_statistics(labelled(docs, labels, "quality", per_class), "doc_id", "quality").orderBy(hash_order(11, F.col("doc_id")), "doc_id", *STATS).collect()
    bad = np.array([r.quality == 0 for r in rows], bool)
    if not bad.any() or bad.all():
        return []
    return learn(np.array([[r[s] for s in STATS] for r in rows], float), bad)


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, rule (0: none) and keep for each row of docs."""
    return with_statistics(docs, "doc_id").select("doc_id", decision(rules).alias("rule")).withColumn("keep", F.col("rule") == 0)


def judge(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    return apply(docs, fit(docs, labels, per_class))

"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length (words parted by white space). A source's
budget is its weight times the total. Of each length the same share of its documents is taken,
rounded by a seeded draw, within the budget; the rest is fitted by a bounded knapsack over what remains
of each length, so a source ends exactly on its budget if any choice of its documents does,
else just below it. Which documents of a length are taken goes by a seeded hash.

Without given weights a source weighs tokens ** TEMPERATURE, the total is SHARE of all tokens if none
is given, and a source with fewer tokens than its budget gives all of them, what it lacks going to the
others by weight. With given weights but no total, it is the greatest that no source falls short of.

Defined results: a null source is a source of its own; null texts have length 0, and documents of
length 0 are always kept, as they cost nothing; weights of sources that are not there count as
asked for but stay unfilled, sources without a given weight get 0. Repeated rows are documents
of their own; ties in the hash go by doc_id, and equal rows are interchangeable. A text of any length
counts whole. Columns of any name pass through, but that n_tokens is replaced. An empty table gives no rows.

Budgets are made on the driver from one number a source; histograms stay with the tasks, one for each
source. Meeting a budget exactly may take bit sets as long as the budget (fit), which only sources of few
lengths come to.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_if_small
from lodestone.session import materialise, ship

TEMPERATURE = 0.5
#: Share of all tokens that is taken where neither weights nor a total are given.
SHARE = 0.95
SEED = 17
#: Tokens of a remainder that the knapsack's bit set holds at first, see fit().
TABLE = 1 << 13


def token_length(column: str = "text") -> Column:
    """Words parted by white space; 0 for null and blank texts."""
    t = F.trim(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def subset_sum(items: Mapping[int, int], budget: int) -> dict[int, int]:
    """Counts by length, within those given, whose total is the greatest that budget allows.

    reach is a bit set of totals; items are split in powers of two. Exact for any budget.
    """
    reach, steps = 1, []
    mask = (1 << (budget + 1)) - 1
    for size, count in sorted(items.items(), reverse=True):
        if size <= 0 or size > budget:
            continue
        k, left = 1, min(count, budget // size)
        while left > 0:
            take = min(k, left)
            new = reach | (reach << (size * take)) & mask
            if new != reach:
                steps.append((size, take, reach))
                reach = new
            left -= take
            k *= 2
        if reach >> budget & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            out[size] = out.get(size, 0) + take
            total -= size * take
    return out


def _draw(seed: int, size: int) -> float:
    """A reproducible number in [0, 1) for a length."""
    return zlib.crc32(f"{seed}|{size}".encode()) / 2**32


def fit(counts: Mapping[int, int], budget: int, seed: int = SEED) -> dict[int, int]:
    """How many documents of each length to take: the same share of each, then a knapsack over the rest.

    Shares are rounded up or down by a seeded draw for each length, so rare lengths are neither always
    nor never taken. Lengths in the order of their draws fill what is left down to TABLE tokens, and
    the knapsack meets that remainder exactly if any choice of the remaining documents does, else
    from below; in that case the share is lowered and all is fitted again with more documents left,
    then with ever larger remainders, the last of which is the whole budget. Sizes are divided by what
    divides them all, and no total can be nearer to the budget than the multiple of that below it.
    """
    total = sum(size * n for size, n in counts.items())
    if total <= budget:
        return dict(counts)
    order = sorted((s for s in counts if s > 0), key=lambda s: (_draw(seed, s), s))
    best: dict[int, int] = {}
    best_sum = -1
    unit = math.gcd(*order)
    goal = budget // unit * unit
    tables = [TABLE << 3 * k for k in range(1, 64) if TABLE << 3 * (k - 1) < budget]
    for slack, table in [*((s, TABLE) for s in (0.0, 0.02, 0.2, 1.0)), *((min(1.0, t / budget), t) for t in tables)]:
        share = budget / total * (1 - slack)
        take = {size: int(counts[size] * share) for size in order}
        left = budget - sum(size * n for size, n in take.items())
        for size in order:
            up = counts[size] * share - take[size] > 1 - _draw(seed + 1, size)
            if up and take[size] < counts[size] and size <= left:
                take[size] += 1
                left -= size
        for size in order:
            if left <= table:
                break
            k = min(counts[size] - take[size], (left - table) // size)
            take[size] += k
            left -= k * size
        rest = {size // unit: counts[size] - take[size] for size in order if counts[size] > take[size]}
        for size, k in subset_sum(rest, left // unit).items():
            take[size * unit] += k
        got = sum(size * n for size, n in take.items())
        if got > best_sum:
            best, best_sum = take, got
        if got == goal:
            break
    return best | {0: counts[0]} if 0 in counts else best


def _filled(tokens: Mapping, w: Mapping, total: float) -> dict:
    """Budgets by weight of total; what a source cannot fill is shared out among the others."""
    out = {s: 0 for s in tokens}
    left, rest = total, [s for s in tokens if w[s] > 0]
    while rest:
        unit = left / math.fsum(w[s] for s in rest)
        short = [s for s in rest if tokens[s] <= unit * w[s]]
        for s in short or rest:
            out[s] = min(int(unit * w[s] + 1e-6), tokens[s])
        if not short:
            break
        left -= sum(tokens[s] for s in short)
        rest = [s for s in rest if s not in short]
    return out


def budgets(tokens: Mapping, weights: Mapping | None = None, total: int | None = None) -> dict:
    """Token budget of each source."""
    if weights is None:
        return _filled(tokens, {s: float(n) ** TEMPERATURE for s, n in tokens.items()}, sum(tokens.values()) * SHARE if total is None else total)
    w = {s: weights.get(s, 0.0) for s in tokens}
    whole = sum(w.values()) + sum(v for s, v in weights.items() if s not in tokens)
    if not any(v > 0 for v in w.values()):
        return {s: 0 for s in tokens}
    unit = min(tokens[s] / w[s] for s in tokens if w[s] > 0) if total is None else total / whole
    return {s: min(int(unit * w[s] + 1e-6), tokens[s]) for s in tokens}


def _plan(light: DataFrame, p: str, weights: Mapping | None, total: int | None, seed: int) -> DataFrame:
    """(source, length, have, take) for every source and length: budgets on the driver by source, the knapsacks in a task for each source."""
    source, size = f"{p}_source", f"{p}_len"
    counts = materialise(light.groupBy(source, size).agg(F.count("*").alias(f"{p}_have")), "histogram")
    tokens = {r[0]: r[1] for r in counts.groupBy(source).agg(F.sum(F.col(size) * F.col(f"{p}_have"))).collect()}
    want = budgets(tokens, weights, total)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[source].iloc[0]
        have = dict(zip(rows[size].tolist(), rows[f"{p}_have"].tolist()))
        take = fit(have, want[None if pd.isna(own) else own], seed)
        return rows.assign(**{f"{p}_take": [take.get(k, 0) for k in have]})

    return materialise(counts.groupBy(source).applyInPandas(fitted, f"{source} string, {size} long, {p}_have long, {p}_take long"), "plan")


def _keyed(docs: DataFrame, seed: int, p: str = "_mx") -> DataFrame:
    return docs.withColumn(f"{p}_source", F.col("source").cast("string")).withColumn(f"{p}_len", token_length()).withColumn(f"{p}_order", F.xxhash64(F.lit(seed), F.col("doc_id")))


def mix(docs: DataFrame, weights: Mapping | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The selected rows of docs, all columns, their token length in n_tokens (a column of that name is replaced).

    Texts are never shuffled: the k-th smallest hash of every source and length is found on
    narrow rows, and a scan keeps what is at or below it. Only where several rows of one
    hash straddle the cut are these rows ranked.
    """
    ship(docs.sparkSession)
    p = "_mx"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = f"_{p}"
    source, size, order, have, take = (f"{p}_{c}" for c in ("source", "len", "order", "have", "take"))
    light = materialise(_keyed(docs.select("doc_id", "source", "text"), seed, p).select("doc_id", source, size, order), "lengths")
    plan = broadcast_if_small(_plan(light, p, weights, total, seed), 48)
    part = light.join(plan.where((F.col(take) > 0) & (F.col(take) < F.col(have))), light[source].eqNullSafe(plan[source]) & (light[size] == plan[size])).select(light[source], light[size], order, take)
    rank = Window.partitionBy(source, size).orderBy(order)
    tied = part.groupBy(source, size, order, take).agg(F.count("*").alias("same")).withColumn("upto", F.sum("same").over(rank))
    name = (F.col(source).alias(f"{p}_s"), F.col(size).alias(f"{p}_l"))
    cut = tied.where((F.col("upto") >= F.col(take)) & (F.col("upto") - F.col("same") < F.col(take))).select(*name, F.col(order).alias(f"{p}_cut"), (F.col(take) - F.col("upto") + F.col("same")).alias(f"{p}_keep"), (F.col("upto") > F.col(take)).alias(f"{p}_split"))
    whole = plan.where(F.col(take) == F.col(have)).select(*name, F.lit((1 << 63) - 1).alias(f"{p}_cut"), F.lit(0).cast("long").alias(f"{p}_keep"), F.lit(False).alias(f"{p}_split"))
    edge = broadcast_if_small(materialise(whole.unionByName(cut), "cuts"), 48)
    full = _keyed(docs, seed, p).join(edge, F.col(source).eqNullSafe(F.col(f"{p}_s")) & (F.col(size) == F.col(f"{p}_l")))
    columns = [*(c for c in docs.columns if c.lower() != "n_tokens"), F.col(size).alias("n_tokens")]
    at_cut = F.col(order) == F.col(f"{p}_cut")
    sure = full.where((F.col(order) < F.col(f"{p}_cut")) | (at_cut & ~F.col(f"{p}_split"))).select(*columns)
    if edge.where(f"{p}_split").isEmpty():
        return sure
    at = full.where(at_cut & F.col(f"{p}_split")).withColumn(f"{p}_rank", F.row_number().over(Window.partitionBy(source, size).orderBy("doc_id")))
    return sure.unionByName(at.where(F.col(f"{p}_rank") <= F.col(f"{p}_keep")).select(*columns))


def selected(docs: DataFrame, weights: Mapping | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens of the selected documents."""
    return mix(docs.select("doc_id", "source", "text"), weights, total, seed).select("doc_id", "source", "n_tokens")

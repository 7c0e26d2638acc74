"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws u in (0, 1) from the
hash of its own path and the key, and the child of least -ln(u) / weight wins, so a child wins
with probability weight / sum. A draw depends on nothing but child and key: when a weight
changes, keys move only into or out of that child at its level, and below all other
children nothing moves. All of it is a projection without shuffle.

Defined results: a null doc_id is keyed as the text '<null>'; repeated rows go to the same shard;
ties in the draws go to the first child in the order of the tree. Children of weight 0 get
nothing; a tree without a child of positive weight is refused. An empty table gives no rows.
Extra columns are kept by shard_docs; columns named region, rack or shard are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Region -> (weight, rack -> (weight, shard -> weight)).
TREE = {
    "r0": (2.0, {"a": (1.0, {"s0": 1.0, "s1": 1.0}), "b": (1.0, {"s0": 1.0, "s1": 2.0})}),
    "r1": (1.0, {"a": (3.0, {"s0": 1.0, "s1": 1.0, "s2": 1.0}), "b": (1.0, {"s0": 1.0})}),
    "r2": (1.0, {"a": (1.0, {"s0": 2.0, "s1": 1.0})}),
}


def _draw(path: str, weight: float, key: str) -> str:
    """SQL of -ln(u) / weight; u from the first 52 bits of an md5, never 0."""
    return f"(-ln((conv(substring(md5(concat('{path}|', {key})), 1, 13), 16, 10) + 0.5D) / 4503599627370496D) / {weight!r}D)"


def _duck_draw(path: str, weight: float, key: str) -> str:
    return f"(-ln((CAST('0x' || substring(md5(concat('{path}|', {key})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) / {weight!r})"


def _pick(children: list[tuple[str, str, float]], key: str, draw) -> str:
    """SQL of the name of the child with the least draw; the first on ties."""
    live = [c for c in children if c[2] > 0]
    if not live:
        raise ValueError("no child of positive weight")
    if len(live) == 1:
        return f"'{live[0][1]}'"
    draws = [draw(p, w, key) for p, _, w in live]
    return "CASE " + " ".join(f"WHEN {d} <= least({', '.join(draws)}) THEN '{n}'" for d, (_, n, _) in list(zip(draws, live))[:-1]) + f" ELSE '{live[-1][1]}' END"


def _levels(tree: dict, key: str, draw) -> tuple[str, str, str]:
    def check(name: str) -> str:
        if not name.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"name of a child: {name!r}")
        return name

    region = _pick([(check(r), r, w) for r, (w, _) in tree.items()], key, draw)
    racks = " ".join(f"WHEN region = '{r}' THEN {_pick([(f'{r}/{check(k)}', k, w) for k, (w, _) in racks.items()], key, draw)}" for r, (w, racks) in tree.items() if w > 0)
    shards = " ".join(f"WHEN region = '{r}' AND rack = '{k}' THEN {_pick([(f'{r}/{k}/{check(s)}', s, x) for s, x in shards.items()], key, draw)}" for r, (w, racks) in tree.items() if w > 0 for k, (v, shards) in racks.items() if v > 0)
    return region, f"CASE {racks} END", f"CASE {shards} END"


def shard_docs(docs: DataFrame, tree: dict = TREE, key: str = "doc_id") -> DataFrame:
    """docs with region, rack and shard."""
    k: Column = F.coalesce(F.col(key).cast("string"), F.lit("<null>"))
    region, rack, shard = _levels(tree, "_key", _draw)
    out = docs.drop("region", "rack", "shard", "_key").withColumn("_key", k)
    return out.withColumn("region", F.expr(region)).withColumn("rack", F.expr(rack)).withColumn("shard", F.expr(shard)).drop("_key")


def assignments(docs: DataFrame, tree: dict = TREE) -> DataFrame:
    """doc_id, region, rack, shard."""
    return shard_docs(docs.select("doc_id"), tree)


def write_shards(docs: DataFrame, path: str, tree: dict = TREE) -> None:
    """docs as Parquet under region=/rack=/shard= folders."""
    shard_docs(docs, tree).write.partitionBy("region", "rack", "shard").parquet(path)


def oracle(tree: dict = TREE, source: str = "documents") -> str:
    region, rack, shard = _levels(tree, "_key", _duck_draw)
    return f"""WITH k AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '<null>') AS _key FROM {source}),
a AS (SELECT *, {region} AS region FROM k),
b AS (SELECT *, {rack} AS rack FROM a)
SELECT doc_id, region, rack, {shard} AS shard FROM b"""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing, sharding, tiling


def test_subset_sum_against_enumeration():
    items = {3: 2, 5: 1, 7: 2, 11: 1}
    sums = {sum(s * k for s, k in zip(items, ks)) for ks in itertools.product(*(range(n + 1) for n in items.values()))}
    for budget in range(40):
        got = mixing.subset_sum(items, budget)
        assert all(0 < k <= items[s] for s, k in got.items())
        assert sum(s * k for s, k in got.items()) == max(x for x in sums if x <= budget)


def test_fit_meets_budgets_exactly():
    counts = {n: 1 + n % 4 for n in range(40, 300)}
    for budget in (0, 17, 5_000, 40_001, 10**9):
        take = mixing.fit(counts, budget)
        got = sum(s * k for s, k in take.items())
        assert all(k <= counts[s] for s, k in take.items())
        assert got == (0 if budget < 40 else min(budget, sum(s * n for s, n in counts.items())))


def test_fit_meets_budgets_of_long_documents():
    assert mixing.fit({20002: 1, 15001: 1, 14999: 1}, 30000) == {20002: 0, 15001: 1, 14999: 1}
    counts = {mixing.TABLE + 997 * k + k * k: 1 + k % 2 for k in range(1, 7)}
    sums = sorted({sum(s * k for s, k in zip(counts, ks)) for ks in itertools.product(*(range(n + 1) for n in counts.values()))})
    for budget in [*sums[1::9], *(s + 3 for s in sums[2::17])]:
        take = mixing.fit(counts, budget)
        assert all(0 <= k <= counts[s] for s, k in take.items())
        assert sum(s * k for s, k in take.items()) == max(s for s in sums if s <= budget)
    take = mixing.fit({10_000: 50_000}, 123_456_789)
    assert take == {10_000: 12_345}


def test_fit_equals_the_whole_knapsack_in_random_cases():
    r = random.Random(4)
    for _ in range(1500):
        counts = {r.randint(3_000, 20_000): r.randint(1, 5) for _ in range(r.randint(1, 8))}
        budget = r.randint(1, sum(s * n for s, n in counts.items()) - 1)
        take = mixing.fit(counts, budget)
        assert all(0 <= k <= counts[s] for s, k in take.items())
        assert sum(s * k for s, k in take.items()) == sum(s * k for s, k in mixing.subset_sum(counts, budget).items()), (counts, budget)


def test_mix_with_clashing_names_takes_what_fit_says(spark, documents):
    odd = documents.withColumn("_mx_source", F.lit("x")).withColumn("_MX_len", F.lit(5)).withColumn("N_tokens", F.lit("y")).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 2)))
    got = mixing.mix(odd, total=15_000)
    assert got.columns == [*odd.columns[:-1], "n_tokens"]
    rows = [(r.source, len((r.text or "").split())) for r in odd.select("source", "text").collect()]
    by = {}
    for s, n in rows:
        by.setdefault(s, {}).setdefault(n, 0)
        by[s][n] += 1
    want = mixing.budgets({s: sum(k * n for k, n in c.items()) for s, c in by.items()}, total=15_000)
    taken = {}
    for r in got.collect():
        assert (r._mx_source, r._MX_len) == ("x", 5)
        taken[r.source, r.n_tokens] = taken.get((r.source, r.n_tokens), 0) + 1
    assert taken == {(s, k): n for s, c in by.items() for k, n in mixing.fit(c, want[s]).items() if n}


def test_mix_hits_targets(documents):
    d = documents.withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b"))
    got = mixing.selected(d, {"a": 1.0, "b": 1.0}, 10_000)
    by = {r.source: r.n for r in got.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert by == {"a": 5_000, "b": 5_000}
    assert got.groupBy("doc_id").count().where("count > 1").count() == 0
    again = mixing.selected(d.repartition(7), {"a": 1.0, "b": 1.0}, 10_000)
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in got.collect()}
    other = mixing.selected(d, {"a": 1.0, "b": 1.0}, 10_000, seed=99)
    assert {r.doc_id for r in other.collect()} != {r.doc_id for r in got.collect()}


def test_mix_takes_least_hashes_of_each_length(documents):
    light = mixing._keyed(documents.select("doc_id", "source", "text"), mixing.SEED).select("doc_id", "_mx_source", "_mx_len", "_mx_order").collect()
    got = {r.doc_id for r in mixing.selected(documents, total=20_000).collect()}
    groups = {}
    for r in light:
        groups.setdefault((r._mx_source, r._mx_len), []).append((r._mx_order, r.doc_id))
    for g in groups.values():
        g.sort()
        taken = [d in got for _, d in g]
        assert taken == sorted(taken, reverse=True)


def test_mix_odd_rows(odd, empty, spark):
    out = mixing.mix(odd, total=10)
    assert out.columns == odd.columns and out.where("n_tokens is null").count() == 0
    assert {2, 3, 4} <= {r.doc_id for r in out.where("n_tokens = 0").collect()}
    assert mixing.mix(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c", "x")] * 5 + [(2, "a b", "y")], "doc_id long, text string, source string")
    got = mixing.selected(same, {"x": 1.0}, 6).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(1, 3), (1, 3)]


def test_budgets():
    assert mixing.budgets({"a": 100, "b": 100}, {"a": 3.0, "b": 1.0}) == {"a": 100, "b": 33}
    assert mixing.budgets({"a": 100}, {"z": 1.0}, 50) == {"a": 0}


def test_a_scarce_source_does_not_shrink_the_others(spark):
    got = mixing.budgets({"a": 1_000_000, None: 4})
    assert got[None] == 4 and 949_000 <= got["a"] <= 950_004
    got = mixing.budgets({"a": 1000, "b": 100, "c": 10}, total=1050)
    assert got == {"a": 940, "b": 100, "c": 10}
    assert mixing.budgets({"a": 0, "b": 0}) == {"a": 0, "b": 0}
    docs = spark.createDataFrame([(i, "w " * 10, "big") for i in range(1000)] + [(-1, "a b c d", None)], "doc_id long, text string, source string")
    by = {r.source: r.n for r in mixing.selected(docs).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert by == {"big": 9490, None: 4}


def test_sharding_equals_sql(spark, documents, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(sharding.oracle()).fetchall())
    assert sorted((r.doc_id, r.region, r.rack, r.shard) for r in sharding.assignments(documents).collect()) == want


def test_sharding_confines_movement(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"))
    tree = {r: (w, {k: (v, dict(s)) for k, (v, s) in racks.items()}) for r, (w, racks) in sharding.TREE.items()}
    tree["r0"][1]["a"] = (1.0, {"s0": 3.0, "s1": 1.0})
    a = {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.shard_docs(keys).collect()}
    b = {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.shard_docs(keys, tree).collect()}
    moved = {k for k in a if a[k] != b[k]}
    assert moved and all(a[k] == ("r0", "a", "s1") and b[k] == ("r0", "a", "s0") for k in moved)
    share = sum(v[0] == "r0" for v in a.values()) / len(a)
    assert abs(share - 0.5) < 0.04


def test_sharding_odd_rows(odd, empty):
    out = sharding.shard_docs(odd.withColumn("rack", F.lit(1)))
    assert out.where("region is null or rack is null or shard is null").count() == 0 and out.count() == odd.count()
    assert sharding.shard_docs(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_docs(empty, {"r": (0.0, {"k": (1.0, {"s": 1.0})})})


def naive_tiles(a, b, least):
    """Greedy string tiling by the definition: the longest match of unmarked words, over and over."""
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if (k, -i, -j) > (best[0], -best[1], -best[2]):
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        fa[i : i + k] = [False] * k
        fb[j : j + k] = [False] * k
        out.append((i, j, k))


def test_tiles_against_the_definition():
    for seed in range(60):
        r = random.Random(seed)
        a = [r.choice("abcd") for _ in range(r.randint(3, 40))]
        b = [r.choice("abcd") for _ in range(r.randint(3, 60))] + a[5:15]
        got, want = tiling.tiles(a, b, 3), naive_tiles(a, b, 3)
        assert sum(k for _, _, k in got) == sum(k for _, _, k in want), seed


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, coverage string")


def test_reordered_passages_are_found_both_ways(spark, make):
    item = " ".join(f"q{i}" for i in range(40))
    w = item.split()
    texts = ["lead in " + item + " tail", "x " + " ".join(w[20:] + ["and"] + w[:20]) + " y", " ".join(w[:12]) + " other words", "none of it at all here", " ".join(x for i in range(0, 40, 3) for x in (*w[i : i + 3], "zz"))]
    b = bench(spark, [(7, item, "x"), (8, None, "x"), (9, "tiny one", "x"), (10, "", "x")])
    docs = make([*texts, "a tiny one too", None, ""])
    want = {(0, 7), (1, 7), (5, 9)}
    for limit in (1 << 26, -1):
        assert {(r.doc_id, r.item_id) for r in tiling.find(docs, b, limit=limit).collect()} == want
        kept = tiling.filter_docs(docs, b, limit=limit)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 6, 7}


def test_tiling_odd_rows(odd, empty, spark):
    b = bench(spark, [(1, "a b c d e f g", "x")])
    for limit in (1 << 26, -1):
        assert sorted((r.doc_id or 0) for r in tiling.find(odd, b, limit=limit).collect()) == [0, 1, 1]
        assert tiling.filter_docs(odd, b, limit=limit).count() == odd.count() - 3
        assert tiling.find(empty, b, limit=limit).count() == 0
        assert tiling.find(odd, bench(spark, []), limit=limit).count() == 0


def naive_find(docs, items, seed=tiling.SEED, coverage=tiling.COVERAGE):
    out = []
    for d, t in docs:
        for k, x in items:
            a, b = re.findall(r"\w+", (x or "").lower()), re.findall(r"\w+", (t or "").lower())
            if a and b:
                got = sum(n for _, _, n in naive_tiles(a, b, min(seed, len(a)))) / len(a)
                if got >= coverage:
                    out.append((d, k, round(got, 9)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_both_paths_equal_a_naive_tiler_in_many_scripts(spark, limit):
    items = [
        (1, "हिन्दी"),
        (2, "भारत में बहुत सारी भाषाएँ बोली जाती हैं और लिखी जाती हैं"),
        (3, "ภาษาไทย ที่ นี่"),
        (4, "İstanbul'da IŞIK ışıl ışıl İĞNE gibi"),
        (5, "le café crème coûte cher à l'hôtel près d'ici"),
        (6, "e\u0301te\u0301 a\u0300 la mer"),
        (7, " ".join(f"q{i % 23}" for i in range(90))),
        (7, "ab cd"),
        (8, None),
        (9, "  "),
    ]
    long = " ".join(f"z{i}" for i in range(3000))
    texts = [
        "यह हिन्दी है",
        "कल भारत में बहुत सारी भाषाएँ बोली जाती हैं वहाँ और लिखी जाती हैं",
        "ภาษาไทย ที่ นี่ ดี",
        "istanbul'da ışık ışıl ışıl iğne gibi",
        "İSTANBUL'DA IŞIK IŞIL IŞIL İĞNE GİBİ",
        "LE CAFÉ CRÈME COÛTE CHER, à l'hôtel près d'ici",
        "e\u0301te\u0301 A\u0300 la mer",
        "été à la mer",
        long + " " + " ".join(f"q{i % 23}" for i in range(45, 90)) + " " + long + " ab cd",
        " ".join(f"q{i % 23}" for i in range(30)) + " x " + " ".join(f"q{i % 23}" for i in range(30, 60)),
        None,
        "",
        "ab cd",
    ]
    docs = [*enumerate(texts), (None, "ab cd"), (12, "ab cd")]
    df = spark.createDataFrame([(d, t, 77, "a", "b") for d, t in docs], "doc_id long, text string, rid long, _RID string, coverage string")
    b = spark.createDataFrame([(k, t, 5) for k, t in items], "item_id long, text string, iid int")
    got = sorted(((r.doc_id, r.item_id, round(r.coverage, 9)) for r in tiling.find(df, b, limit=limit).collect()), key=str)
    want = sorted(naive_find([x for x in docs if x[0] is not None], items) + [(None, 7, 1.0)], key=str)
    assert got == want
    kept = tiling.filter_docs(df, b, limit=limit)
    assert kept.columns == df.columns and {(r.rid, r._RID) for r in kept.collect()} <= {(77, "a")}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d is not None and d not in {x[0] for x in want})

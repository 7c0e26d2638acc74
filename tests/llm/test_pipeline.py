from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestone.llm import chosen_path, ftrl, mixing, sharding, tiling


def test_stages_do_what_their_operators_decide(spark, sf, documents, labels):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = documents
    out = {}
    for name, stage in cp.STAGES:
        out[name] = stage(spark, docs, sf)
        if name != "shard":
            assert out[name].columns == documents.columns
        before, docs = docs, spark.createDataFrame(out[name].collect(), out[name].schema)
        ids, had = {r.doc_id for r in docs.collect()}, {r.doc_id for r in before.collect()}
        assert ids <= had
        if name == "quality":
            assert ids == {r.doc_id for r in ftrl.classify(before, labels).where("keep").collect()}
        elif name == "near_duplicates":
            pairs = chosen_path.jaccard_join(before).collect()
            assert before.groupBy("doc_id").count().where("count > 1").isEmpty()
            root = {d: d for d in had}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for p in pairs:
                a, b = sorted((find(p.doc_a), find(p.doc_b)))
                root[b] = a
            assert ids == {d for d in had if find(d) == d} and len(ids) < len(had)
        elif name == "decontaminate":
            assert had - ids == {r.doc_id for r in tiling.find(before, benchmark).collect()}
        elif name == "mix":
            assert ids == {r.doc_id for r in mixing.selected(before).collect()}
        else:
            assert ids == had and docs.columns[-3:] == ["region", "rack", "shard"]
            assert {(r.doc_id, r.shard) for r in docs.collect()} == {(r.doc_id, r.shard) for r in sharding.assignments(before).collect()}


def test_run_equals_the_stages(spark, sf, documents):
    docs = documents
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    key = lambda r: tuple(map(str, r))
    assert sorted(cp.run(spark, sf).collect(), key=key) == sorted(docs.collect(), key=key)


def test_near_duplicates_keeps_one_of_repeated_rows(spark, sf, odd):
    out = cp.near_duplicates(spark, odd, sf)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6]


def test_near_duplicates_keeps_other_texts_of_a_doc_id(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (1, b), (2, b.replace("b30", "x")), (3, a.upper()), (4, " ".join(f"c{i}" for i in range(60))), (None, a)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), "extra", "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, body string, rec string")
    out = cp.near_duplicates(spark, docs, sf)
    assert out.columns == cp.COLUMNS
    assert sorted(((r.doc_id or 0), r.text[0]) for r in out.collect()) == [(0, "a"), (1, "a"), (1, "b"), (4, "c")]


def test_stages_with_extra_columns(spark, sf, documents, odd):
    docs = documents.limit(40).unionByName(odd, True).withColumn("rid", F.lit("x")).withColumn("_mx_len", F.lit(1)).withColumn("shard", F.lit("old"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() > 0
        assert out.columns == cp.COLUMNS if name != "shard" else out.where("shard = 'old'").isEmpty()


def test_stages_on_an_empty_table(spark, sf, empty):
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_near_duplicates_of_a_large_group_writes_no_table_of_its_pairs(spark, sf, make, monkeypatch):
    n, counts = 600, {}
    base = [f"w{i}" for i in range(60)]
    docs = make([" ".join(base[: k % 60] + [f"x{k}"] + base[k % 60 + 1 :]) for k in range(n)])
    write = chosen_path.materialise

    def counted(df, name, *more):
        out = write(df, name, *more)
        counts[name] = max(out.count(), counts.get(name, 0))
        return out

    monkeypatch.setattr(chosen_path, "materialise", counted)
    assert [r.doc_id for r in cp.near_duplicates(spark, docs, sf).collect()] == [0]
    assert max(counts.values()) < 40 * n

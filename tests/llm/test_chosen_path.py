import itertools
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute

from lodestone.llm import chosen_path as cp
from lodestone.llm.queries import QUERIES


def shingles(text, n=cp.NGRAM):
    w = re.findall(r"\w+", text.lower())
    n = min(n, len(w))
    return frozenset(zip(*[w[i:] for i in range(n)])) if w else frozenset()


def brute(rows, threshold=cp.THRESHOLD):
    sets = {d: shingles(t) for d, t in rows if d is not None and t}
    rep = {}
    for d in sorted(sets):
        if sets[d]:
            rep.setdefault(sets[d], d)
    near = {tuple(sorted((rep[a], rep[b]))) for a, b in itertools.combinations(rep, 2) if len(a & b) / len(a | b) >= threshold}
    return near | {(rep[s], d) for d, s in sets.items() if s and rep[s] != d}


def test_recall_against_brute_force(documents):
    want = brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    got = {(r.doc_a, r.doc_b) for r in cp.jaccard_join(documents).collect()}
    assert got <= want and len(got & want) >= 0.9 * len(want) and want


def test_one_large_group_and_ties(make):
    base = " ".join(f"w{i}" for i in range(120))
    texts = [base.replace(f"w{i} ", f"x{i} ") for i in range(1, 100)] + [base] * 5 + [" ".join(f"z{i}_{k}" for i in range(100)) for k in range(30)]
    docs = make(texts)
    want = brute(list(enumerate(texts)))
    got = {(r.doc_a, r.doc_b): r.jaccard for r in cp.jaccard_join(docs, brute=8).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want)
    assert all(got[99, k] == 1.0 for k in range(100, 104))
    groups = {r.doc_id: r.rep for r in cp.groups(cp.jaccard_join(docs, brute=8)).collect()}
    assert groups == {i: 0 for i in range(104)}


def test_odd_rows(odd, empty):
    assert cp.jaccard_join(odd).collect() == []
    assert cp.jaccard_join(empty).collect() == []
    assert cp.groups(cp.jaccard_join(empty)).collect() == []


def test_runs_rise_with_recall_and_fall_with_threshold():
    assert cp.runs(0.6, 0.99) >= cp.runs(0.6, 0.9) >= cp.runs(0.9, 0.9) >= 1


def test_no_pair_at_the_threshold_is_left_out(make):
    """Each pair shares 9 of 15 n-grams; of 2,000, a join that meets pairs by chance misses some."""
    texts = []
    for i in range(2_000):
        w = [f"w{i}_{k}" for k in range(14)]
        texts += [" ".join(w), " ".join(w[:7] + ["x"] + w[8:])]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in cp.jaccard_join(make(texts)).collect()}
    assert got == {(i, i + 1): 0.6 for i in range(0, 4_000, 2)}


def expected(rows, threshold=cp.THRESHOLD):
    """(doc_id, class_id, links) of rows of different doc_ids, by brute force."""
    sets = {d: shingles(t or "") for d, t in rows if d is not None}
    linked = {d: [e for e in sets if e != d and s and sets[e] and len(s & sets[e]) / len(s | sets[e]) >= threshold] for d, s in sets.items()}
    least = {d: d for d in sets}
    for _ in sets:
        least = {d: min([least[d], *(least[e] for e in linked[d])]) for d in sets}
    return {(d, least[d], len(linked[d])) for d in sets} | {(None, None, 0) for d, _ in rows if d is None}


def clusters():
    base = [[f"c{c}_{i}" for i in range(60)] for c in range(3)]
    near = [" ".join(w[: k % 60] + [f"x{k}"] + w[k % 60 + 1 :]) for w in base for k in range(70)]
    return near + [" ".join(w) for w in base for _ in range(4)] + ["one two", "One, two!", "", "?!", Ellipsis]


def test_links_of_clusters_in_blocks_against_brute_force(make, monkeypatch):
    monkeypatch.setattr(cp, "TOKENS", 5_000)
    texts = clusters()
    docs = make(texts)
    got = [tuple(r) for r in cp.links(docs, brute=8).collect()]
    assert len(got) == len(texts)
    assert set(got) == expected([(None if t is Ellipsis else i, None if t is Ellipsis else t) for i, t in enumerate(texts)])


def test_links_of_documents_against_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert {tuple(r) for r in cp.links(documents, brute=2).collect()} == expected(rows)


def test_links_of_odd_rows(odd, empty):
    assert sorted(((r.doc_id or 0), (r.class_id or 0), r.links) for r in cp.links(odd).collect()) == [(k, k, 0) for k in range(7)]
    assert cp.links(empty).collect() == []


def test_op5_has_a_row_for_each_document(spark, make, tmp_path):
    n = 200
    base = [f"w{i}" for i in range(60)]
    make([" ".join(base[: k % 60] + [f"x{k}"] + base[k % 60 + 1 :]) for k in range(n)]).write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op5_ngram_jaccard_join"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in out) == [(k, 0, n - 1) for k in range(n)]


def test_pairs_of_a_part_are_counted_in_bounded_memory(monkeypatch):
    """Lists of 30 records: 100,000 postings make 1,450,000 pairs, which a task doesn't hold together."""
    monkeypatch.setattr(cp, "PAIRS", 50_000, raising=False)
    rng = np.random.default_rng(0)
    token = np.repeat(rng.permutation(100_000)[:3_334].astype(np.uint32), 30)
    key = (rng.integers(0, 40, 3_334)[:, None] * 30 + np.arange(30)).astype(np.int64).ravel()
    place, size = np.zeros(len(token), np.int64), np.full(len(token), 350, np.int64)
    packed = [token.tobytes(), key.tobytes(), cp._planes(place), cp._planes(size)]
    columns = [pa.array([0], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.int32()), *(pa.array([x], pa.binary()) for x in packed)]
    batch = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in cp._POSTED.split(", ")])
    want = Counter()
    for own in key.reshape(-1, 30):
        want.update(itertools.combinations(own.tolist(), 2))
    got = Counter()
    tracemalloc.start()
    try:
        for b in cp._lists(cp.THRESHOLD, 32)(iter([batch])):
            b = b.filter(pa.compute.equal(b.column("kind"), 0))
            for a, c, n in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("n").to_pylist()):
                got[a, c] += n
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == want
    assert peak < 40e6


def test_pairs_that_come_in_several_turns_and_a_short_order_give_the_same_links(make, monkeypatch):
    monkeypatch.setattr(cp, "PAIRS", 50, raising=False)
    monkeypatch.setattr(cp, "RANKED", 64, raising=False)
    texts = clusters()
    docs = make(texts)
    clean = docs.selectExpr("doc_id", "xxhash64(text) body", "text").where("doc_id is not null and text is not null")
    token, count = cp._order(clean, cp.NGRAM, len(texts))
    assert 0 < len(token) <= 64 and (token[1:] > token[:-1]).all() and count.min() > 1
    for brute in (8, 400):
        assert {tuple(r) for r in cp.links(docs, brute=brute).collect()} == expected([(None if t is Ellipsis else i, None if t is Ellipsis else t) for i, t in enumerate(texts)])

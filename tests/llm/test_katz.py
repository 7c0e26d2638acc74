import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import katz


def brute(texts, vocab, order=katz.ORDER):
    """The model by dictionaries: p(history, w) with the nearest word last, the vocabulary, the texts as tokens and all histories."""
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    c = Counter(w for ws in words for w in ws)
    keep, reach = set(), 0
    for n in sorted(set(c.values()), reverse=True):
        new = [w for w in c if c[w] == n]
        if reach + len(new) > vocab:
            break
        reach += len(new)
        keep |= set(new)
    seqs = [[w if w in keep else "<unk>" for w in ws] + ["</s>"] for ws in words]
    uni = Counter({w: c[w] for w in keep})
    d1 = katz.discounts(Counter(uni.values()))
    total = sum(uni.values()) + len(texts) + sum(c.values()) - sum(uni.values()) + 1
    p1 = {w: (d1[n] if n <= katz.K else 1) * n / total for w, n in uni.items()}
    p1["</s>"] = len(texts) / total
    p1["<unk>"] = 1 - sum(p1.values())
    grams = {k: defaultdict(Counter) for k in range(2, order + 1)}
    for s in seqs:
        full = ["<s>"] * (order - 1) + s
        for i in range(order - 1, len(full)):
            for k in grams:
                grams[k][tuple(full[i - k + 1 : i])][full[i]] += 1
    d = {k: katz.discounts(Counter(n for ws in g.values() for n in ws.values())) for k, g in grams.items()}
    made = {}

    def weights(h):
        if h not in made:
            k = len(h) + 1
            own = grams[k][h]
            size = sum(own.values())
            seen = {x: (d[k][n] if n <= katz.K else 1) * n / size for x, n in own.items()}
            free = max(1 - sum(seen.values()), 1 / (size + 1))
            rest = 1 - sum(p(h[1:], x) for x in seen)
            scale, alpha = (1 / sum(seen.values()), 0) if rest <= 1e-12 else ((1 - free) / sum(seen.values()), free / rest)
            made[h] = {x: v * scale for x, v in seen.items()}, alpha
        return made[h]

    def p(h, w):
        if not h:
            return p1[w]
        if h not in grams[len(h) + 1]:
            return p(h[1:], w)
        seen, alpha = weights(h)
        return seen[w] if w in seen else alpha * p(h[1:], w)

    return p, [*p1], seqs, [h for g in grams.values() for h in g]


def log_prob(p, s, order=katz.ORDER):
    full = ["<s>"] * (order - 1) + s
    return sum(math.log(p(tuple(full[i - order + 1 : i]), full[i])) for i in range(order - 1, len(full)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_dictionaries(documents, order):
    docs = documents.where("doc_id < 60")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    p, vocab, seqs, hist = brute([r.text for r in rows], 400, order)
    got = {r.doc_id: r for r in katz.score_corpus(docs, 400, order).collect()}
    for r, s in zip(rows, seqs):
        lp = log_prob(p, s, order)
        assert np.isclose(got[r.doc_id].log_prob, lp) and got[r.doc_id].n_tokens == len(s)
        assert np.isclose(got[r.doc_id].perplexity, math.exp(-lp / len(s)))
    for h in [*hist[:20], *hist[-20:]]:
        assert np.isclose(sum(p(h, w) for w in vocab), 1)


def test_weights_sum_to_one_in_the_tables(documents):
    model, _ = katz.train(documents.where("doc_id < 80"), 300)
    assert np.isclose(model.p1.sum(), 1)
    size = len(model.p1)
    rng = np.random.default_rng(2)
    for row in model.ngrams.collect():
        g = model.grams(row["keys"], row["counts"])
        own = np.stack(g.columns())
        for i in rng.integers(0, own.shape[1], 3).tolist():
            far = rng.integers(0, size)
            for history in (own[:-1, i], np.array([own[0, i], far])):
                every = np.stack([*(np.full(size, h, np.uint32) for h in history), np.arange(size, dtype=np.uint32)])
                assert np.isclose(np.exp(g.log_p(every)).sum(), 1)
    weights = model.histories().collect()
    assert {r.order for r in weights} == {2, 3} and all(0 <= r.alpha for r in weights) and all(len(r.history) == r.order - 1 for r in weights)


def test_other_documents_back_off_as_the_dictionaries(make, documents):
    docs = documents.where("doc_id < 60")
    rows = docs.orderBy("doc_id").collect()
    p, vocab, seqs, _ = brute([r.text for r in rows], 400)
    model, _ = katz.train(docs, 400)
    known = [w for w in vocab if w.isalpha()]
    texts = [" ".join(known[(7 * i * i + k) % len(known)] for i in range(30)) for k in range(5)] + [" ".join(seqs[3][:9] + seqs[4][2:9]), "never seen words here", "", None]
    got = katz.score(model, make(texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        s = [w if w in vocab else "<unk>" for w in re.findall(r"\w+", (t or "").lower())] + ["</s>"]
        assert r.n_tokens == len(s) and np.isclose(r.log_prob, log_prob(p, s))


def test_sums_are_the_same_every_time(documents):
    docs = documents.where("doc_id < 60")
    assert {(r.doc_id, r.log_prob) for r in katz.score_corpus(docs).collect()} == {(r.doc_id, r.log_prob) for r in katz.score_corpus(docs).collect()}


def test_packing():
    rng = np.random.default_rng(0)
    for dtype in (np.uint8, np.uint32, np.uint64, np.int64, np.float64):
        for n in (0, 1, 1000):
            a = (rng.random(n) * 1e6).astype(dtype)
            assert (katz.unpack(katz.pack(a), dtype) == a).all()
    cols = [np.sort(rng.integers(0, 50, 200)).astype(np.uint32), rng.integers(0, 2**32, 200).astype(np.uint32), rng.integers(0, 9, 200).astype(np.uint32)]
    assert (katz.unpack_grams(katz.pack_grams(cols), 3) == np.stack(cols)).all()


def test_odd_rows(odd, empty):
    out = katz.score_corpus(odd)
    assert out.count() == odd.count() and out.where("log_prob is null or isnan(log_prob)").count() == 0
    assert out.where("doc_id is null").count() == 1 and out.where("doc_id = 1").count() == 2
    assert katz.score_corpus(empty).count() == 0
    with pytest.raises(ValueError):
        katz.train(odd, order=1)


def test_good_turing():
    d = katz.discounts({1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6})
    a = 6 * 6 / 100
    assert np.isclose(d[1], ((2 * 40 / 100) - a) / (1 - a)) and (d <= 1).all()
    assert (katz.discounts({}) == 1).all()


def test_every_word_is_kept(make):
    texts = [" ".join(f"w{k}x{i}" for i in range(5_000)) + " often" * (k % 7) + "".join(f" r{i}" * (1 + i % 6) for i in range(k % 9)) for k in range(42)]
    docs = make(texts)
    model, _ = katz.train(docs)
    c = Counter(w for t in texts for w in t.split())
    assert len(c) > 200_000 and {(r.word, r["count"]) for r in model.unigrams.where("id > 2").collect()} == set(c.items())
    assert np.isclose(model.p1.sum(), 1) and model.unigrams.agg(F.countDistinct("id"), F.max("id")).first() == (len(c) + 3, len(c) + 2)
    p, _, seqs, _ = brute(texts, 10**9)
    got = {r.doc_id: r.log_prob for r in katz.score_corpus(docs).collect()}
    for k in (0, 8, 41):
        assert "<unk>" not in seqs[k] and np.isclose(got[k], log_prob(p, seqs[k]))


def test_scoring_the_corpus_writes_no_ngrams(spark, documents, monkeypatch):
    made, write = {}, katz.materialise
    monkeypatch.setattr(katz, "materialise", lambda df, name, *by: made.setdefault(name, []).append(write(df, name, *by)) or made[name][-1])
    docs = documents.where("doc_id < 40")
    own = {r.doc_id: r.log_prob for r in katz.score_corpus(docs).collect()}
    assert made["ngrams"][0].where("keys is not null or counts is not null").count() == 0
    model, _ = katz.train(docs)
    assert made["ngrams"][1].where("keys is null or counts is null").count() == 0
    other = {r.doc_id: r.log_prob for r in katz.score(model, docs).collect()}
    assert own.keys() == other.keys() and all(abs(own[k] - other[k]) < 1e-6 for k in own)

import bisect
import math
import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from lodestone.llm import ftrl, rules, toxicity
from lodestone.llm.common import WordHash, mix, word_hashes


def test_ftrl_held_out_accuracy(documents, labels):
    train, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    got = ftrl.classify(documents, train).join(held, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) >= 0.9 * len(got)
    assert all(r.keep for r in got if r.quality == 1 and r.quality_score > 0.9)


def test_ftrl_scores_are_sparse_dot_products(documents, labels):
    w, bias = ftrl.fit(documents, labels)
    for r in ftrl.classify(documents, labels).join(documents.select("doc_id", "text"), "doc_id").limit(20).collect():
        i, v = ftrl.features(r.text, WordHash())
        assert np.isclose(r.quality_score, 1 / (1 + np.exp(-(bias + sum(w[a] * b for a, b in zip(i, v))))))
        assert np.isclose((v * v).sum(), 1)


def test_ftrl_scores_of_the_whole_table_by_definition(documents, labels):
    w, bias = ftrl.fit(documents, labels)
    cache = WordHash()
    want = {}
    for r in documents.select("doc_id", "text").collect():
        tokens = re.findall(r"\w+|[^\w\s]+", r.text or "")
        h = [int(x) for x in word_hashes(tokens, cache)]
        grams = h + [int(mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:])]
        idx = [max(g >> (64 - ftrl.BITS), 0) for g in grams]
        c = Counter(i + 2 if i < 2 else i for i in idx)
        same = sum(a == b for a, b in zip(h, h[1:])) + sum(a == b for a, b in zip(h, h[2:]))
        total = Counter({ftrl.REPEAT: same, ftrl.AGAIN: len(grams) - len(c)})
        total.update(c)
        n = sum(total.values())
        want[r.doc_id] = 1 / (1 + math.exp(-(bias + sum(float(w[i]) * math.sqrt(k / n) for i, k in total.items() if k))))
    got = ftrl.classify(documents, labels).collect()
    assert len(got) == len(want) and all(r.keep == (r.quality_score >= 0.5) for r in got)
    off = [(r.doc_id, r.quality_score, want[r.doc_id]) for r in got if not math.isclose(r.quality_score, want[r.doc_id], rel_tol=1e-9, abs_tol=1e-12)]
    assert not off, off[:5]


def test_scores_of_very_long_texts(make, documents, labels):
    long = "plain words of prose and more " * 40_000
    docs = make([long, long + "!", "x" * 300_000])
    model = ftrl.fit(documents, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", ftrl.score_column(model).alias("s")).collect()}
    i, v = ftrl.features(long, WordHash())
    assert np.isclose(got[0], 1 / (1 + np.exp(-(model[1] + model[0][i] @ v)))) and 0 < got[2] < 1
    out = toxicity.score(docs, toxicity.fit(documents, labels)).collect()
    assert len(out) == 3 and not any(r.toxic for r in out)
    assert rules.apply(docs, rules.fit(documents, labels)).count() == 3


def test_ftrl_odd_rows(odd, empty, documents, labels, spark):
    out = ftrl.classify(odd.unionByName(documents, True), labels)
    assert out.count() == odd.count() + documents.count() and out.where("quality_score is null").count() == 0
    assert ftrl.classify(empty, labels).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert ftrl.classify(odd, none).where("keep").count() == odd.count()
    assert ftrl.filter_docs(odd, none).columns == odd.columns


def test_rules_are_what_their_terms_say(documents, labels):
    learned = rules.fit(documents, labels)
    assert learned
    stats = rules.with_statistics(documents, "doc_id").collect()
    x = np.array([[r[s] for s in rules.STATS] for r in stats])
    want = np.zeros(len(x), int)
    for k, rule in reversed(list(enumerate(learned, 1))):
        want[rule.mask(x)] = k
    got = {r.doc_id: r.rule for r in rules.apply(documents, learned).collect()}
    assert got == {r.doc_id: int(k) for r, k in zip(stats, want)}


def test_rules_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(documents, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = ([r for r in got if r.quality == q] for q in (1, 0))
    assert sum(r.keep for r in good) >= 0.95 * len(good)
    assert bad and sum(not r.keep for r in bad) >= 0.7 * len(bad)


def statistics(text):
    """The statistics of rules by their definitions."""
    t = text or ""
    words = [w for w in re.split(r"\s+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" ")]
    share = lambda a, b: a / b if b else 0.0
    chars = lambda p: sum(len(m) for m in regex.findall(p, t))
    return [len(t), len(words), share(sum(map(len, words)), len(words)), share(len(set(words)), len(words)), share(chars(r"[^\p{L}\p{N}\s]+"), len(t)), share(chars(r"\p{Lu}+"), len(t)), share(chars(r"\p{N}+"), len(t)), len(lines), share(len(set(lines)), len(lines)), share(sum(a == b for a, b in zip(words, words[1:])), len(words))]


def test_rules_of_the_whole_table_by_definition(documents, labels):
    learned = rules.fit(documents, labels)
    want = {}
    for r in documents.select("doc_id", "text").collect():
        x = dict(zip(rules.STATS, statistics(r.text)))
        hit = [k for k, rule in enumerate(learned, 1) if all(x[n] <= cut if op == "<=" else x[n] > cut for n, op, cut in rule.terms)]
        want[r.doc_id] = hit[0] if hit else 0
    got = rules.judge(documents, labels).collect()
    assert {r.doc_id: r.rule for r in got} == want and all(r.keep == (r.rule == 0) for r in got) and len(got) == documents.count()
    assert set(want.values()) > {0}


def test_rules_statistics_by_hand(make):
    r = rules.with_statistics(make(["Aa bb bb 1!\nx", None, "  "]), "doc_id").orderBy("doc_id").collect()
    assert (r[0].n_chars, r[0].n_words, r[0].lines) == (13, 5, 2)
    assert np.isclose(r[0].repeat_share, 0.2) and np.isclose(r[0].distinct_share, 0.8) and np.isclose(r[0].capital_share, 1 / 13) and np.isclose(r[0].mark_share, 1 / 13)
    assert all(r[1][s] == 0 for s in rules.STATS) and r[2].n_words == 0


def test_rules_learn_a_planted_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 2] <= 0.4)
    got = rules.learn(x, bad, ["a", "b", "c"])
    hit = np.zeros(len(x), bool)
    for r in got:
        hit |= r.mask(x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97


def test_rules_odd_rows(odd, empty, labels, documents, spark):
    assert rules.judge(odd.unionByName(documents, True), labels).count() == odd.count() + documents.count()
    assert rules.judge(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.judge(odd, none).where("keep").count() == odd.count()


def test_toxicity_on_planted_words(spark, make):
    good = [f"alpha beta{i} gamma delta{i} epsilon{i} zeta" for i in range(120)]
    bad = [f"alpha you idiot delta{i} epsilon{i} what a moron{i}" for i in range(60)] + [f"alpha{i} grumpf{chr(97 + i % 7)} delta{i} grumpfig zeta" for i in range(60)]
    docs = make(good + bad)
    labels = spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(240) if i % 5], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.detect(docs, labels).collect()}
    assert sum(got[i] == (i >= 120) for i in range(240)) >= 236
    assert any(b.startswith("grum") for b in toxicity.fit(docs, labels)[0][1])


def test_toxicity_obfuscation(make):
    pattern = toxicity.obfuscated_pattern(["idiot"])
    d = make(["an 1d10t", "an i.d.i.o.t", "an idiot", "idiotic"]).select("doc_id", F.regexp_count(F.lower("text"), F.lit(pattern)).alias("n"))
    assert [r.n for r in d.orderBy("doc_id").collect()] == [1, 1, 0, 0]


def test_toxicity_disguise_of_words_under_a_learned_beginning(spark, make):
    good = [f"alpha beta{i} gamma delta{i} epsilon{i} zeta" for i in range(120)]
    bad = [f"alpha beta{i} {'idiot' if i % 3 else 'i.d.i.o.t'} delta{i} {'idiot' if i % 3 else 'm_o_r_o_n'} zeta" for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i >= 120)) for i in range(240)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(make(good + bad), labels)
    assert "idio" in model[0][1] and "idiot" not in model[0][0]
    new = make(["alpha beta7 i.d.i.o.t delta7 epsilon7 zeta", "alpha beta7 id!0tic delta7 epsilon7 zeta", "alpha beta7 gamma delta7 epsilon7 zeta"])
    rows = toxicity.with_features(new, *model[0], "doc_id").orderBy("doc_id").collect()
    assert [r.obfuscated for r in rows] == [1, 1, 0]
    assert [r.toxic for r in toxicity.score(new, model).orderBy("doc_id").collect()] == [True, True, False]


def test_toxicity_of_the_whole_table_by_definition(spark):
    """Features by another regex engine, trees walked by hand and the calibration interpolated by hand, for every document."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon, trees, (xs, ps) = toxicity.fit(documents, labels)
    words, begins, wide, hidden = lexicon
    lex = regex.compile(toxicity.lexicon_pattern(words, begins))
    broad = regex.compile(toxicity.lexicon_pattern([], wide)) if wide else None
    hide = regex.compile(toxicity.obfuscated_pattern(hidden, begins))
    person = "(?<![\\p{L}])(?:" + toxicity._any(list(toxicity.SECOND)) + ")(?![\\p{L}])"
    gap = "(?:[^\\p{L}\\p{N}]+[\\p{L}\\p{N}]+){0,3}[^\\p{L}\\p{N}]+"
    near = regex.compile(f"{person}{gap}{lex.pattern}|{lex.pattern}[\\p{{L}}]*{gap}{person}")
    n_of = lambda p, t: sum(1 for _ in p.finditer(t))
    want = {}
    for r in documents.select("doc_id", "text").collect():
        t = r.text or ""
        low, n, k = t.lower(), max(len(t), 1), len(t.split())
        hits = n_of(lex, low)
        loose = hits + (n_of(broad, low) if broad else 0)
        chars = lambda p, t=t: sum(len(m) for m in regex.findall(p, t))
        x = [hits, hits * 1000 / max(k, 1), loose, loose * 1000 / max(k, 1), n_of(near, low) if hits else 0, n_of(hide, low), len(regex.findall("(?<=\\p{L})[0134578@$](?=\\p{L})", low)) * 1000 / max(k, 1), chars("\\p{Lu}+") / n, len(regex.findall("[!?]+", t)) * 1000 / max(k, 1), chars("[^\\p{L}\\p{N}\\s]+") / n, k]
        raw = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            at = 0
            for _ in range(toxicity.DEPTH):
                at = 2 * at + (2 if x[f[at]] > c[at] else 1)
            raw += v[at - (2**toxicity.DEPTH - 1)]
        i = bisect.bisect_right(xs.tolist(), raw)
        p = ps[0] if i == 0 else ps[-1] if i == len(xs) else ps[i - 1] + (ps[i] - ps[i - 1]) * (raw - xs[i - 1]) / (xs[i] - xs[i - 1])
        want[r.doc_id] = p if k else 0.0
    got = {r.doc_id: r for r in toxicity.detect(documents, labels).collect()}
    assert len(got) == documents.count()
    off = [d for d in want if not math.isclose(got[d].probability, want[d], abs_tol=1e-6)]
    assert not off, off[:5]
    assert all(r.toxic == (r.probability >= toxicity.THRESHOLD) for r in got.values())


def test_toxicity_odd_rows(odd, empty, documents, labels, spark):
    out = toxicity.detect(odd.unionByName(documents, True), labels)
    assert out.count() == odd.count() + documents.count() and out.where("probability is null or toxic is null").count() == 0
    assert out.where("doc_id = 2 and toxic").count() == 0
    assert toxicity.detect(empty, labels).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.detect(odd, none).where("toxic").count() == 0


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    s = rng.random(500)
    y = (rng.random(500) < s).astype(float)
    xs, ps = toxicity.isotonic(s, y)
    assert (np.diff(ps) >= -1e-12).all() and np.isclose(np.interp(s, xs, ps).mean(), y.mean())

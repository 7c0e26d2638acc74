import numpy as np

from lodestone.llm import bpe, chat, token_counts

E = bpe.encoding(bpe.ranks())


def test_counts_equal_the_tokenizer(documents):
    want = {r.doc_id: len(E.encode_ordinary(r.text)) for r in documents.select("doc_id", "text").collect()}
    for hot in (token_counts.HOT, 200, 0):
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents, hot=hot).collect()} == want


def test_counts_of_odd_texts(make):
    texts = ["", None, "   ", "it's they'll\n\n\n  x", "a b c\x1cd", "漢字 🙂🙂  ½²", "'s 's", "x" * 30_000, "<|endoftext|>"]
    want = [len(E.encode_ordinary(t or "")) for t in texts]
    got = token_counts.token_counts(make(texts)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == want


def test_counts_odd_rows(odd, empty):
    got = token_counts.token_counts(odd)
    assert got.count() == odd.count() and got.where("doc_id = 1").count() == 2 and got.where("doc_id is null and n_tokens > 0").count() == 1
    assert token_counts.token_counts(empty).count() == 0


def conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")


def merged(spans):
    out = []
    for s, e in spans:
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def check_tree(convs, out, leaf):
    """Every node against its ancestors, and every conversation against the tokens of its path."""
    nodes = {r.node_id: r for r in out}
    assert len(nodes) == len(out)
    trees = {}
    for n in nodes.values():
        trees.setdefault(n.tree_id, []).append(n)
    for own in trees.values():
        own.sort(key=lambda n: n.start)
        assert [n.start for n in own] == list(np.cumsum([0, *(len(n.tokens) for n in own)])[:-1])
        for n in own:
            up, k = [], n.parent_id
            while k:
                up.insert(0, nodes[k])
                k = nodes[k].parent_id
            assert [(a.start, a.end) for a in n.attend] == merged([(u.start, u.start + len(u.tokens)) for u in up])
            assert n.depth == len(up) and n.tree_id == (up[0].node_id if up else n.node_id)
            base = sum(len(u.tokens) for u in up)
            assert n.position_ids == list(range(base, base + len(n.tokens)))
            # Depth first: a subtree is one stretch of the row.
            below, size = {n.node_id}, len(n.tokens)
            for m in own:
                if m.start > n.start and m.parent_id in below:
                    below.add(m.node_id)
                    size += len(m.tokens)
            assert all(n.start <= nodes[k].start < n.start + size for k in below)
    role_id, text_id, end_id = chat.reserved(bpe.ranks())
    turns, through = {}, {}
    for r in convs:
        if r.conv_id is not None:
            turns.setdefault(r.conv_id, set()).add((r.turn is not None, r.turn, r.role or "unknown", r.text or ""))
    assert turns.keys() == leaf.keys()
    for c, t in turns.items():
        if len({x[:3] for x in t}) == len(t):
            want = [x for _, _, role, text in sorted(t, key=lambda x: (x[0], x[1] or 0, x[2])) for x in [role_id, *E.encode_ordinary(role), text_id, *E.encode_ordinary(text), end_id]]
        else:
            want = None  # ties go by hash
        got, k, n = [], leaf[c], 0
        while k:
            through[k] = through.get(k, 0) + 1
            got, k, n = nodes[k].tokens + got, nodes[k].parent_id, n + 1
        assert n == len(t) and (want is None or got == want)
    assert through == {k: n.n_conversations for k, n in nodes.items()}
    ends = {}
    for k in leaf.values():
        ends[k] = ends.get(k, 0) + 1
    assert {k: v.n_ends for k, v in nodes.items() if v.n_ends} == ends
    return nodes


def both(convs):
    return chat.tree(convs).collect(), {r.conv_id: r.node_id for r in chat.leaves(convs).collect()}


def test_tree_round_trip_and_attention(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    extra = conv(spark, [(9001, 0, "system", "be brief", "x"), (9001, 1, "user", "hi", "x"), (9001, 2, "assistant", "yo", "x"), (9002, 0, "system", "be brief", "x"), (9002, 1, "user", "hi", "x"), (9002, 2, "assistant", "hello", "x"), (9003, 0, "system", "be brief", "x"), (9003, 1, "user", "bye", "x"), (9004, 0, "system", "be brief", "x"), (9004, 1, "user", "hi", "x")])
    convs = table.unionByName(extra, True)
    nodes = check_tree(convs.collect(), *both(convs))
    shared = next(n for n in nodes.values() if n.depth == 0 and n.n_conversations == 4)
    assert sum(n.tree_id == shared.tree_id for n in nodes.values()) == 5


def test_tree_over_many_ranges(spark):
    """One tree that every range shares, copies of one conversation, prefixes and a second tree."""
    rows = []
    for c in range(300):
        depth = 1 + c % 7
        rows += [(c, k, "user" if k else "system", "be brief" if k < 2 else f"t{(c * 7919) % 5 ** min(k, 4)}" + "w " * (k % 3), "x") for k in range(depth)]
    rows += [(1000 + c, k, "user", f"same {k}", "x") for c in range(40) for k in range(4)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            convs = conv(spark, rows)
            check_tree(convs.collect(), *both(convs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_tree_tells_roles_from_texts(spark):
    rows = [(1, 0, "a\x1fb", "c", ""), (2, 0, "a", "b\x1fc", ""), (3, 0, "user", "<|assistant|>\nyes", ""), (4, 0, "user<|", "x", ""), (5, 0, "ab", "c", ""), (6, 0, "a", "bc", "")]
    out = chat.tree(conv(spark, rows)).collect()
    assert len({r.node_id for r in out}) == 6
    special = set(chat.reserved(bpe.ranks()))
    assert all(sum(x in special for x in r.tokens) == 3 for r in out)


def test_tree_odd_rows(spark):
    rows = [(None, 0, "user", "x", "a"), (1, None, None, None, "a"), (1, None, None, None, "a"), (1, 0, "user", "", "a"), (2, 0, "user", "w " * 60_000, None), (3, 1, "user", "b", "x"), (3, 1, "user", "a", "x"), (3, 1, "user", "a", "y")]
    convs = conv(spark, rows)
    out, leaf = both(convs)
    assert len(out) == 5 and all(r.tokens for r in out)
    check_tree(convs.collect(), out, leaf)
    assert chat.tree(conv(spark, [])).collect() == []

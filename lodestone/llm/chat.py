"""Chat formatting as a prefix tree.

Conversations that share initial turns share nodes. A node is a turn with all turns before it; its
id is a hash chained over them. The tokens of a node are emitted once. Nodes of a tree lie depth
first (children by id), so a node covers [start, start + length) of the tree's token row.
position_ids run on from the parent, as if the conversation stood alone. attend lists the spans
that the ancestors cover, which a token sees besides the earlier tokens of its own node; spans
that touch are one, so their number grows with the branchings above a node and not with its depth.

A turn is the reserved id ROLE, the tokens of the role, the reserved id TEXT, the tokens of the text and
the reserved id END. Reserved ids follow the vocabulary (reserved()), so no role or text can write them.

Only (conversation, turn, hash, length) rows are grouped and sorted. Conversations sorted by
their paths list a tree depth first: what one does not share with the one before it is its own
nodes. The sort is by ranges of whole paths, so a prefix that very many share is not one task's;
what the ranges before have laid reaches each range as one state, made on the driver from one row a range.
Tokens are shuffled once, to the nodes that own them.

Defined results: rows of a null conv_id are dropped; a null role is 'unknown', a null text empty;
turns are ordered by turn (null first), then role, then hash of the turn, and exact repeats of a
row count once. One conversation that is a prefix of another ends in an inner node. Texts are
encoded whole, however long. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.llm.common import broadcast_if_small, by_key, spans
from lodestone.session import materialise, ship

_PATHS = "conv_id long, path array<binary>, lengths array<int>, rids array<long>"
_NODES = "owned boolean, tree_id binary, node_id binary, parent_id binary, depth int, start long, offset long, attend array<struct<start:long,end:long>>, rid long, n long, n_ends long"


def reserved(raw: bytes) -> tuple[int, int, int]:
    """ROLE, TEXT and END: the three ids after the vocabulary."""
    n = bpe.encoding(raw).n_vocab
    return n, n + 1, n + 2


def _encode(raw: bytes):
    @F.pandas_udf("array<int>")
    def encode(roles: pd.Series, texts: pd.Series) -> pd.Series:
        e = bpe.encoding(raw).encode_ordinary
        role, text, end = reserved(raw)
        return pd.Series([[role, *e(r), text, *e(t), end] for r, t in zip(roles, texts)])

    return encode


def encoded(conversations: DataFrame, path: str = bpe.PATH) -> DataFrame:
    """(rid, conv_id, turn, role, turn_hash, tokens, length) of each row with a conv_id, written out so that rid stays."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # The length of the role parts it from the text, whatever marks either holds.
    own = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    t = t.select("conv_id", "turn", "role", own.alias("turn_hash"), _encode(bpe.ranks(path))("role", "text").alias("tokens"))
    return materialise(t.withColumn("length", F.size("tokens")).withColumn("rid", F.monotonically_increasing_id()), "encoded")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each conversation, from its rows in order: every id hashes the one before with the turn."""
    for t in by_key(batches, "conv_id"):
        conv = t.column("conv_id").combine_chunks().to_numpy()
        turn, hashes = t.column("turn").to_pylist(), t.column("turn_hash").to_pylist()
        length, rid = t.column("length").to_pylist(), t.column("rid").to_pylist()
        out = []
        for lo, hi in spans(conv):
            last, path, own = b"", [], []
            for i in range(lo, hi):
                if i > lo and turn[i] == turn[i - 1] and hashes[i] == hashes[i - 1]:
                    continue
                last = hashlib.md5(last + hashes[i]).digest()
                path.append(last)
                own.append(i)
            out.append((int(conv[lo]), path, [length[i] for i in own], [rid[i] for i in own]))
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.binary())), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.int64()))], ["conv_id", "path", "lengths", "rids"])


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, lengths, rids) of every conversation of encoded rows: node ids of its prefixes, token lengths, rows."""
    small = rows.select("conv_id", "turn", "role", "turn_hash", "length", "rid").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "turn_hash", "rid")
    return small.drop("role").mapInArrow(_chain, _PATHS)


def _shared(a: list[bytes], b: list[bytes]) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


@dataclass
class State:
    """What lies before a range: the last path with the starts and lengths of its nodes, and the tokens laid in its tree."""

    path: list[bytes] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    laid: int = 0


class Walk:
    """Depth-first walk over conversations in the order of their paths."""

    def __init__(self, before: State):
        self.stack: list[list] = []
        self.path, self.laid = list(before.path), before.laid
        self.done: list[tuple] = []
        for node, start, length in zip(before.path, before.starts, before.lengths):
            self._push(node, start, length, None, 0)

    def _push(self, node: bytes, start: int, length: int, rid: int | None, ends: int) -> None:
        """An entry: node, start, length, offset of its positions, spans of its ancestors, rid (None: of an earlier range), count, ends."""
        if self.stack:
            _, s, n, offset, attend, *_ = self.stack[-1]
            attend = [*attend[:-1], (attend[-1][0], s + n)] if attend and attend[-1][1] == s else [*attend, (s, s + n)]
            self.stack.append([node, start, length, offset + n, attend, rid, 0, ends])
        else:
            self.stack.append([node, start, length, 0, [], rid, 0, ends])

    def _pop(self) -> None:
        node, start, _, offset, attend, rid, n, ends = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        if up:
            up[6] += n
        if rid is not None or n:
            self.done.append((rid is not None, self.path[0], node, up[0] if up else None, len(self.stack), start, offset, attend, rid, n, ends))

    def add(self, path: list[bytes], lengths: list[int], rids: list[int], n: int) -> None:
        keep = _shared(self.path, path)
        while len(self.stack) > keep:
            self._pop()
        if not keep:
            self.laid = 0
        self.path = path
        for k in range(keep, len(path)):
            self._push(path[k], self.laid, lengths[k], rids[k], n if k == len(path) - 1 else 0)
            self.laid += lengths[k]
        self.stack[-1][6] += n

    def close(self) -> None:
        while self.stack:
            self._pop()


def _rows(batch: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("path", "lengths", "rids", "n")))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range its first path, and its last with starts as if no range lay before it."""
    for t in by_key(batches, "part"):
        part = t.column("part").combine_chunks().to_numpy()
        for lo, hi in spans(part):
            walk, first = Walk(State()), None
            for path, lengths, rids, n in _rows(t.slice(lo, hi - lo)):
                first = first or path
                walk.add(path, lengths, rids, n)
                walk.done.clear()
            row = (int(part[lo]), first, walk.path, [e[1] for e in walk.stack], [e[2] for e in walk.stack], walk.laid)
            kinds = (pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["part", "first", "last", "starts", "lengths", "laid"])


def states(summaries: list) -> dict[int, State]:
    """The state before each range, from the summaries of all."""
    out, now = {}, State()
    for r in sorted(summaries, key=lambda r: r.part):
        out[r.part] = now
        first, last = [bytes(x) for x in r.first], [bytes(x) for x in r.last]
        had = _shared(now.path, first)
        if not had or last[0] != first[0]:
            now = State(last, list(r.starts), list(r.lengths), r.laid)
            continue
        # The first tree goes on from the range before: its shared nodes lie there, the others follow what was laid.
        shift = now.laid - sum(now.lengths[:had])
        same = min(had, _shared(first, last))
        now = State(last, [*now.starts[:same], *(s + shift for s in r.starts[same:])], list(r.lengths), r.laid + shift)
    return out


def _nodes(before: dict[int, State]):
    kinds = pa.schema([("owned", pa.bool_()), ("tree_id", pa.binary()), ("node_id", pa.binary()), ("parent_id", pa.binary()), ("depth", pa.int32()), ("start", pa.int64()), ("offset", pa.int64()), ("attend", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rid", pa.int64()), ("n", pa.int64()), ("n_ends", pa.int64())])

    def table(done: list[tuple]) -> pa.RecordBatch:
        cols = [list(c) for c in zip(*done)]
        cols[7] = [[{"start": s, "end": e} for s, e in a] for a in cols[7]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds)], schema=kinds)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "part"):
            part = t.column("part").combine_chunks().to_numpy()
            for lo, hi in spans(part):
                walk = Walk(before[int(part[lo])])
                for row in _rows(t.slice(lo, hi - lo)):
                    walk.add(*row)
                    if len(walk.done) > 20_000:
                        yield table(walk.done)
                        walk.done = []
                walk.close()
                if walk.done:
                    yield table(walk.done)

    return fn


def tree(conversations: DataFrame, path: str = bpe.PATH) -> DataFrame:
    """One row for each node: tree_id, node_id, parent_id, depth, start, tokens, position_ids, attend, n_conversations, n_ends."""
    ship(conversations.sparkSession)
    rows = encoded(conversations, path)
    # Equal conversations are one leaf, so that copies of one fill no range.
    leaf = paths(rows).withColumn("leaf", F.element_at("path", -1)).groupBy("leaf").agg(F.count("*").alias("n"), F.first(F.struct("path", "lengths", "rids")).alias("c"))
    order = leaf.select("c.path", "c.lengths", "c.rids", "n").orderBy("path").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    order = materialise(order, "order")
    ranged = order.repartition("part").sortWithinPartitions("part", "at").select("part", "path", "lengths", "rids", "n")
    before = states(ranged.mapInArrow(_summary, "part int, first array<binary>, last array<binary>, starts array<long>, lengths array<long>, laid long").collect())
    found = materialise(ranged.mapInArrow(_nodes(before), _NODES), "nodes")
    # Nodes that reach into later ranges: at most a path's length of rows for each range.
    more = broadcast_if_small(found.where("not owned").groupBy("node_id").agg(F.sum("n").alias("more")), 40)
    nodes = found.where("owned").join(more, "node_id", "left")
    out = nodes.join(rows.select("rid", "tokens"), "rid")
    name = lambda c: F.lower(F.hex(c)).alias(c)
    ids = F.sequence("offset", F.col("offset") + F.size("tokens") - 1)
    return out.select(name("tree_id"), name("node_id"), name("parent_id"), "depth", "start", "tokens", ids.alias("position_ids"), "attend", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_conversations"), "n_ends")


def leaves(conversations: DataFrame, path: str = bpe.PATH) -> DataFrame:
    """(conv_id, node_id): the node in which each conversation ends."""
    ship(conversations.sparkSession)
    return paths(encoded(conversations, path)).select("conv_id", F.lower(F.hex(F.element_at("path", -1))).alias("node_id"))

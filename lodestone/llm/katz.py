"""Language-model scoring by a Katz model of the corpus itself, of any order.

Tokens are lower-cased words; each text ends in </s> and starts after ORDER - 1 times <s>. Every word counted is
in the vocabulary; <unk> is a word of other documents. (A size may be given: then those counted most
often are in it, the rest is <unk>.) Counts r <= K are discounted by Good-Turing, in each order k by itself,
    d_r = (r* / r - A) / (1 - A),   r* = (r + 1) N_{r+1} / N_r,   A = (K + 1) N_{K+1} / N_1,
(1 where that is undefined or outside (0, 1]) and, h' being the history h without its farthest word,
    p_k(w | h) = scale(h) d_r r / C(h)          if r = c(h w) > 0
               = alpha(h) p_{k-1}(w | h')       otherwise (alpha 1 for a history that was not seen),
down to p_1(w), with alpha(h) = (1 - sum of seen p_k(w | h)) / (1 - sum of p_{k-1}(w | h') over seen w), so each
p_k(. | h) sums to 1. scale(h) is 1 unless discounting frees less than 1 / (C(h) + 1), which is then the mass
set free. Unigrams are discounted alike, the mass going to <unk>, which counts one more than was seen.

Tables: unigrams (word, id, count, p) and n-grams of the highest order in the shared folder, these partitioned by a
hash of the word before the last, one packed row a bucket. All lower orders of an n-gram end in the same two words,
so a bucket holds what the recursion of its n-grams asks for: their counts are sums of it, and so are totals, scales
and alphas (Grams). Ids go by falling count, so p(w) is a step function of the id with a step for each distinct
count (Steps), and no task holds the words. Documents are turned into chunks of their own local ids, whose
words, but for the most frequent, which travel with the job, are joined to the unigrams by a shuffle, and then into postings, packed, which are written once as a table bucketed like
the n-grams: counting and scoring both read it without another shuffle, and only sums for each document go on.

Defined results: null and empty texts are the sequence </s> alone; texts count whole, however long; a null doc_id is
kept; repeated rows count each time and each get their row; words of equal count get ids by the word, which no
probability depends on; sums are added in the order of the buckets. Extra columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, by_key, keyed, mix, spans
from lodestone.session import bucketed, materialise, release, ship

K = 5
UNK, START, END = 0, 1, 2
#: Words of an n-gram of the highest order.
ORDER = 3
#: Bits of an id.
BITS = 32
#: Token positions that a task gathers before it sorts and packs them.
FLUSH = 1 << 21
#: Postings that a task sorts at once when it counts n-grams.
SLICE = 1 << 20
#: Bytes of the most frequent words, with 16 for each, that travel with the job; the others get their ids by a join.
HOT = 8 << 20
#: Distinct words that a task counts before it hands them on.
HELD = 300_000


def pack(a: np.ndarray) -> bytes:
    """Compressed by planes of bytes, as the high bytes of ids and counts are nearly all alike."""
    raw = np.ascontiguousarray(a)
    raw = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_grams(cols: list[np.ndarray]) -> bytes:
    """Columns of sorted n-grams, nearest word of the history first, the word last: histories as differences."""
    return pack(np.concatenate([*(np.diff(c, prepend=np.uint32(0)) for c in cols[:-1]), cols[-1]]))


def unpack_grams(b: bytes, order: int) -> np.ndarray:
    a = unpack(b, np.uint32).reshape(order, -1).copy()
    np.cumsum(a[:-1], axis=1, dtype=np.uint32, out=a[:-1])
    return a


def _sorted(cols: list[np.ndarray]) -> np.ndarray:
    """The order of rows by cols, two at a time in one key."""
    keys = [(c[0].astype(np.uint64) << np.uint64(BITS)) | c[1] if len(c) > 1 else c[0] for c in (cols[i : i + 2] for i in range(0, len(cols), 2))]
    return np.lexsort(keys[::-1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "count"])
        seen.clear()
        return out

    for b in batches:
        for t in b.column(0):
            text = t.as_py()
            if text:
                seen.update(WORD.findall(text.lower()))
            if len(seen) > HELD:
                yield flush()
    if seen:
        yield flush()


def discounts(n: dict[int, int], k: int = K) -> np.ndarray:
    """d_0 (unused) to d_k from counts of counts."""
    d = np.ones(k + 1)
    n1, cut = n.get(1, 0), n.get(k + 1, 0)
    a = (k + 1) * cut / n1 if n1 else 1.0
    if not 0 <= a < 1:
        return d
    for r in range(1, k + 1):
        if n.get(r) and n.get(r + 1):
            v = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
            d[r] = v if 0 < v <= 1 else 1.0
    return d


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


class Steps:
    """A probability for each id, equal within a run of ids: first ids of the runs, and the value in each."""

    def __init__(self, sizes: np.ndarray, value: np.ndarray):
        self.first, self.value, self.n = np.r_[0, np.cumsum(sizes)[:-1]], value, int(sizes.sum())

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        return self.value[np.searchsorted(self.first, ids, "right") - 1]

    def sum(self) -> float:
        return float((np.diff(np.r_[self.first, self.n]) * self.value).sum())


def _chunks(hot: pa.Table):
    """Runs of documents as one row each: its tokens as places in its distinct words (0 for </s>, else from 1), the ids of its
    frequent words by place (0 for the others), and the others in the order of their places."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(zip(hot.column("word").to_pylist(), hot.column("id").to_pylist()))
        part, turn = TaskContext.get().partitionId(), itertools.count()
        place: defaultdict[str, int] = defaultdict()
        place.default_factory = lambda: len(place) + 1
        seqs: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            size = np.array([len(s) for s in seqs])
            ids = np.fromiter((known.get(w, 0) for w in place), np.uint32, len(place))
            rare = [w for w, i in zip(place, ids.tolist()) if not i]
            row = [(part << 32) | next(turn), rare, pack(ids), pack(np.concatenate(seqs)), pack(np.array([0 if d is None else d for d in docs], np.int64)), pack(np.array([d is None for d in docs], np.uint8)), pack(size.astype(np.uint32))]
            place.clear()
            seqs.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5))], ["uid", "words", "ids", "seq", "docs", "nulls", "tf"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py()
                w = WORD.findall(text.lower()) if text else []
                s = np.zeros(len(w) + 1, np.uint32)
                s[:-1] = np.fromiter(map(place.__getitem__, w), np.uint32, len(w))
                seqs.append(s)
                docs.append(d)
                held += len(s)
                if held > FLUSH:
                    yield flush()
                    held = 0
        if seqs:
            yield flush()

    return fn


def _packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, at, id) as packed rows of a uid, FLUSH at a time."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        uid, at, ids = (t.column(c).to_numpy() for c in ("uid", "at", "id"))
        order = np.lexsort((at, uid))
        uid, at, ids = uid[order], at[order].astype(np.uint32), ids[order].astype(np.uint32)
        rows = [(int(uid[lo]), pack(np.diff(at[lo:hi], prepend=np.uint32(0))), pack(ids[lo:hi])) for lo, hi in spans(uid)]
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["uid", "at", "ids"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n > FLUSH:
            yield flush(held)
            held, n = [], 0
    if n:
        yield flush(held)


def _histories(flat: np.ndarray, size: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the ids of the words before it, the nearest first; START before the text."""
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = []
    for k in range(1, order):
        h = np.full(len(flat), START, np.uint32)
        inside = at >= k
        h[inside] = flat[np.flatnonzero(inside) - k]
        out.append(h)
    return out


def _postings(buckets: int, order: int):
    """Packed postings of chunks, each a row with seq and packed rows of the ids of its rare words; the row of documents in a bucket below 0."""

    def posted(uid: int, flat: np.ndarray, head: tuple[bytes, bytes, bytes]) -> pa.RecordBatch:
        size = unpack(head[2], np.uint32).astype(np.int64)
        doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
        flat = flat.astype(np.uint32)
        cols = [*_histories(flat, size, order), flat, doc]
        by = _sorted(cols)
        cols = [c[by] for c in cols]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
        new = np.flatnonzero(new)
        tf = np.diff(np.r_[new, len(doc)]).astype(np.uint32)
        cols = [c[new] for c in cols]
        bucket = _bucket(cols[0], buckets)
        by = np.argsort(bucket, kind="stable")
        cols, tf, bucket = [c[by] for c in cols], tf[by], bucket[by]
        rows = [(uid, -1 - uid % buckets, b"", *head)]
        for lo, hi in spans(bucket):
            rows.append((uid, int(bucket[lo]), pack_grams([c[lo:hi] for c in cols[:-1]]), pack(cols[-1][lo:hi]), b"", pack(tf[lo:hi])))
        out = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:])], ["uid", "bucket", "keys", "docs", "nulls", "tf"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "uid"):
            uid = t.column("uid").combine_chunks().to_numpy()
            for lo, hi in spans(uid):
                own = t.slice(lo, hi - lo)
                head = own.filter(pc.is_valid(own.column("seq"))).to_pylist()[0]
                ids = np.r_[np.uint32(END), unpack(head["ids"], np.uint32)]
                rare = np.flatnonzero(ids == 0)
                for r in own.filter(pc.is_null(own.column("seq"))).select(["at", "ids"]).to_pylist():
                    ids[rare[np.cumsum(unpack(r["at"], np.uint32), dtype=np.uint32)]] = unpack(r["ids"], np.uint32)
                yield posted(int(uid[lo]), ids[unpack(head["seq"], np.uint32)], (head["docs"], head["nulls"], head["tf"]))

    return fn


def _code(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (at.astype(np.uint64) << np.uint64(BITS)) | w.astype(np.uint64)


def _runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts code, its distinct values, and where in that order each begins."""
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return order, code[first], first


class Grams:
    """The n-grams of a bucket in all orders, as a tree of histories: node ids of level j number its histories of j words.

    A code of nodes is (node of the nearer words, farther word); one of grams[k] is (node of level k - 1, word).
    """

    def __init__(self, cols: np.ndarray, counts: np.ndarray):
        self.order = len(cols)
        self.nodes: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        at = np.zeros(len(counts), np.uint32)
        for h in cols[:-1]:
            order, node, first = _runs(_code(at, h))
            self.nodes.append(node)
            at[order] = np.repeat(np.arange(len(first), dtype=np.uint32), np.diff(np.r_[first, len(order)]))
            order, code, first = _runs(_code(at, cols[-1]))
            self.codes.append(code)
            self.counts.append(np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64))

    def of_counts(self) -> list[list[int]]:
        """Of each order from 2 how many n-grams have the counts 1 to K + 1."""
        return [np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2].tolist() for c in self.counts]

    def columns(self) -> list[np.ndarray]:
        """The distinct n-grams of the highest order, sorted."""
        at, out = self.codes[-1], []
        out.append(at.astype(np.uint32))
        at = (at >> np.uint64(BITS)).astype(np.int64)
        for node in reversed(self.nodes):
            code = node[at]
            out.append(code.astype(np.uint32))
            at = (code >> np.uint64(BITS)).astype(np.int64)
        return [*out[:0:-1], out[0]]

    def weigh(self, p1: Steps, d: list[np.ndarray]) -> Grams:
        """Totals, scales and alphas of all histories, from the lowest order up."""
        self.p1, self.d = p1, d
        self.total, self.scale, self.alpha = [], [], []
        for k in range(2, self.order + 1):
            code, c, n = self.codes[k - 2], self.counts[k - 2], len(self.nodes[k - 2])
            h, w = (code >> np.uint64(BITS)).astype(np.int64), code & np.uint64((1 << BITS) - 1)
            total = np.bincount(h, c, n)
            seen = np.bincount(h, self._discounted(k, c), n) / total
            free = np.maximum(1 - seen, 1 / (total + 1))
            up = [h]
            for j in range(k - 2, 0, -1):
                up.insert(0, (self.nodes[j][up[0]] >> np.uint64(BITS)).astype(np.int64))
            unseen = 1 - np.bincount(h, self.prob(k - 1, up[: k - 2], w), n)
            # A history after which every word was seen has no unseen word to give mass to.
            every = unseen <= 1e-12
            self.total.append(total)
            self.scale.append(np.where(every, 1 / seen, (1 - free) / seen))
            self.alpha.append(np.where(every, 0.0, free / np.where(every, 1, unseen)))
        return self

    def _discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        return np.where(c <= K, self.d[k - 2][np.minimum(c, K)], 1.0) * c

    def prob(self, k: int, at: list[np.ndarray], w: np.ndarray) -> np.ndarray:
        """p_k of words after histories given by their nodes of levels 1 to k - 1, -1 where one was not seen."""
        if k == 1:
            return self.p1[w.astype(np.int64)]
        node = at[-1]
        seen = node >= 0
        out = np.empty(len(w))
        if len(self.codes[k - 2]):
            code = (np.maximum(node, 0).astype(np.uint64) << np.uint64(BITS)) | w.astype(np.uint64)
            i = np.minimum(np.searchsorted(self.codes[k - 2], code), len(self.codes[k - 2]) - 1)
            seen &= self.codes[k - 2][i] == code
            h = node[seen]
            out[seen] = self.scale[k - 2][h] * self._discounted(k, self.counts[k - 2][i[seen]]) / self.total[k - 2][h]
        else:
            seen = np.zeros(len(w), bool)
        rest = np.flatnonzero(~seen)
        if len(rest):
            low = self.prob(k - 1, [a[rest] for a in at[:-1]], w[rest])
            known = node[rest] >= 0
            if known.any():
                low[known] *= self.alpha[k - 2][node[rest][known]]
            out[rest] = low
        return out

    def find(self, cols: np.ndarray) -> list[np.ndarray]:
        """Nodes of the histories of n-grams, level by level."""
        at, out = np.zeros(cols.shape[1], np.int64), []
        for node, h in zip(self.nodes, cols[:-1]):
            if len(node):
                code = (np.maximum(at, 0).astype(np.uint64) << np.uint64(BITS)) | h.astype(np.uint64)
                i = np.minimum(np.searchsorted(node, code), len(node) - 1)
                at = np.where((at >= 0) & (node[i] == code), i, -1)
            else:
                at = np.full(cols.shape[1], -1, np.int64)
            out.append(at)
        return out

    def log_p(self, cols: np.ndarray) -> np.ndarray:
        """ln p(w | h) of n-grams, those of the table or any other whose nearest word belongs to this bucket."""
        with np.errstate(divide="ignore"):
            return np.log(self.prob(self.order, self.find(cols), cols[-1]))


def _counted(keys: pa.ChunkedArray, tf: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of packed rows and their counts, put together a part of the words at a time, so that little is held at once."""
    parts = [unpack_grams(k.as_py(), order) for k in keys]
    counts = [unpack(c.as_py(), np.uint32) for c in tf]
    slices = 1 + sum(map(len, counts)) // SLICE
    out: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    for k in range(slices):
        which = [p[-1] % np.uint32(slices) == k for p in parts]
        cols = np.concatenate([p[:, w] for p, w in zip(parts, which)], 1) if parts else np.zeros((order, 0), np.uint32)
        c = np.concatenate([x[w] for x, w in zip(counts, which)]) if parts else np.zeros(0, np.uint32)
        if not len(c):
            continue
        by = _sorted(list(cols))
        cols, c = cols[:, by], c[by]
        first = np.flatnonzero(np.r_[True, np.any(cols[:, 1:] != cols[:, :-1], axis=0)])
        out.append(cols[:, first])
        sums.append(np.add.reduceat(c.astype(np.int64), first))
    return (np.concatenate(out, 1), np.concatenate(sums)) if out else (np.zeros((order, 0), np.uint32), np.zeros(0, np.int64))


def _merge(order: int, keep: bool = True):
    """The n-grams and counts of a bucket of postings, one packed row, and what it has of counts of counts; only these without keep."""

    def fn(t: pa.Table) -> pa.Table:
        g = Grams(*_counted(t.column("keys"), t.column("tf"), order))
        packed = (pack_grams(g.columns()), pack(g.counts[-1].astype(np.uint64))) if keep else (None, None)
        row = (t.column("bucket")[0].as_py(), *packed, [x for of in g.of_counts() for x in of])
        return pa.table([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=["bucket", "keys", "counts", "of"])

    return fn


def _weights(p1: Steps, d: list[np.ndarray], order: int):
    """(order, history as ids with the nearest word first, total, scale, alpha) of all histories of buckets."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, c in zip(b.column("keys"), b.column("counts")):
                g = Grams(unpack_grams(k.as_py(), order), unpack(c.as_py(), np.uint64)).weigh(p1, d)
                for j in range(1, order):
                    at, words = np.arange(len(g.nodes[j - 1])), []
                    for node in reversed(g.nodes[:j]):
                        words.insert(0, node[at].astype(np.uint32))
                        at = (node[at] >> np.uint64(BITS)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), j + 1, np.int32)), pa.array(np.stack(words, 1).astype(np.int64).tolist(), pa.list_(pa.int64())), pa.array(g.total[j - 1]), pa.array(g.scale[j - 1]), pa.array(g.alpha[j - 1])], ["order", "history", "total", "scale", "alpha"])

    return fn


@dataclass
class Model:
    unigrams: DataFrame
    ngrams: DataFrame
    p1: Steps
    d: list[np.ndarray]
    buckets: int
    order: int

    def histories(self) -> DataFrame:
        """(order, history, total, scale, alpha), the backoff weights, as they are made from each bucket."""
        return self.ngrams.select("keys", "counts").mapInArrow(_weights(self.p1, self.d, self.order), "order int, history array<long>, total double, scale double, alpha double")

    def grams(self, keys: bytes, counts: bytes) -> Grams:
        return Grams(unpack_grams(keys, self.order), unpack(counts, np.uint64)).weigh(self.p1, self.d)


_SUMS = "uid long, bucket int, docs binary, sums binary"


def _summed(g: Grams, bucket: int, t: pa.Table, order: int) -> pa.Table:
    """Sums of ln p for the documents of each chunk of postings, one after another."""
    rows = []
    for uid, keys, docs, tf in zip(*(t.column(c) for c in ("uid", "keys", "docs", "tf"))):
        lp = g.log_p(unpack_grams(keys.as_py(), order)) * unpack(tf.as_py(), np.uint32)
        which, inv = np.unique(unpack(docs.as_py(), np.uint32), return_inverse=True)
        rows.append((uid.as_py(), bucket, pack(which), pack(np.bincount(inv, lp, len(which)))))
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["uid", "bucket", "docs", "sums"])


def _score(p1: Steps, d: list[np.ndarray], order: int):
    """Sums of a bucket of the corpus's own postings, which are its n-grams too."""

    def fn(t: pa.Table) -> pa.Table:
        g = Grams(*_counted(t.column("keys"), t.column("tf"), order)).weigh(p1, d)
        return _summed(g, t.column("bucket")[0].as_py(), t, order)

    return fn


def _score_others(p1: Steps, d: list[np.ndarray], order: int):
    """Sums of a bucket of postings of any documents, beside the row with the n-grams of the bucket, if it has one."""

    def fn(t: pa.Table) -> pa.Table:
        own = t.filter(pc.is_valid(t.column("counts"))).to_pylist()
        cols, counts = (unpack_grams(own[0]["keys"], order), unpack(own[0]["counts"], np.uint64)) if own else (np.zeros((order, 0), np.uint32), np.zeros(0, np.uint64))
        return _summed(Grams(cols, counts).weigh(p1, d), t.column("bucket")[0].as_py(), t.filter(pc.is_null(t.column("counts"))), order)

    return fn


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of documents of a uid with their sums, added in the order of the buckets."""
    for t in by_key(batches, "uid"):
        uid, bucket = (t.column(c).combine_chunks().to_numpy() for c in ("uid", "bucket"))
        docs, sums, nulls, tf = (t.column(c).combine_chunks() for c in ("docs", "sums", "nulls", "tf"))
        for lo, hi in spans(uid):
            head, *rest = (lo + np.argsort(bucket[lo:hi], kind="stable")).tolist()
            ids, n = unpack(docs[head].as_py(), np.int64), unpack(tf[head].as_py(), np.uint32)
            lp = np.zeros(len(ids))
            for i in rest:
                lp[unpack(docs[i].as_py(), np.uint32)] += unpack(sums[i].as_py(), np.float64)
            none = unpack(nulls[head].as_py(), np.uint8).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(n.astype(np.int64)), pa.array(lp)], ["doc_id", "n_tokens", "log_prob"])


def _hot(unigrams: DataFrame, limit: int = HOT) -> tuple[pa.Table, int]:
    """(word, id) of the most frequent words, whole counts of them within limit bytes, and the first id that is not among them."""
    words = unigrams.where(F.col("id") > END)
    reach, least = 0, 1 << 62
    for r in words.groupBy("count").agg(F.sum(F.octet_length("word") + 16).alias("n")).orderBy(F.desc("count")).toLocalIterator():
        reach += r.n
        if reach > limit:
            break
        least = r["count"]
    table = words.where(F.col("count") >= least).select("word", "id").toArrow()
    return table, END + 1 + table.num_rows


def _postings_of(docs: DataFrame, unigrams: DataFrame, buckets: int, order: int, hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """Postings, not written yet, and the tables that can go once they are."""
    table, first = _hot(unigrams, hot)
    chunks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_chunks(table), "uid long, words array<string>, ids binary, seq binary, docs binary, nulls binary, tf binary")
    chunks = materialise(chunks, "chunks")
    words = chunks.select("uid", F.posexplode("words").alias("at", "word"))
    rare = words.join(unigrams.where(F.col("id") >= first).select("word", "id").hint("merge"), "word").select("uid", "at", "id")
    ids = materialise(rare.mapInArrow(_packed_ids, "uid long, at binary, ids binary"), "ids")
    release(docs.sparkSession)
    blank = F.lit(None).cast("binary")
    heads = chunks.select("uid", blank.alias("at"), "ids", "seq", "docs", "nulls", "tf")
    rows = heads.unionByName(ids.select("uid", "at", "ids", *(blank.alias(c) for c in ("seq", "docs", "nulls", "tf"))))
    return keyed(rows, "uid", _postings(buckets, order), "uid long, bucket int, keys binary, docs binary, nulls binary, tf binary"), [chunks, ids]


def vocabulary(counts: DataFrame, size: int | None) -> tuple[list[tuple[int, int]], int]:
    """(count, words of it) by falling count, all or the most frequent that size holds (whole counts only), and tokens outside."""
    by = [(r["count"], r.n) for r in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect()]
    n = len(by)
    if size is not None:
        n = sum(reach <= size for reach in itertools.accumulate(n for _, n in by))
    return by[:n], sum(c * n for c, n in by[n:])


def _numbered(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, count, id): dense ids from END + 1 by falling count, then by word; and the table that it reads."""
    rows = materialise(counts.orderBy(F.desc("count"), "word").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "numbered")
    parts = sorted((r.part, r.first, r.n) for r in rows.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("n")).collect())
    before = itertools.accumulate((n for _, _, n in parts), initial=END + 1)
    shift = rows.sparkSession.createDataFrame([(p, b - first) for (p, first, _), b in zip(parts, before)], "part int, shift long")
    return rows.join(F.broadcast(shift), "part").select("word", "count", (F.col("at") + F.col("shift")).alias("id")), rows


def train(docs: DataFrame, vocab: int | None = None, order: int = ORDER, keep: bool = True) -> tuple[Model, DataFrame]:
    """The model of docs, and the postings of docs, bucketed. Without keep the n-grams are not written, as the postings hold them."""
    if order < 2:
        raise ValueError(f"order {order}: a history has one word at least")
    spark: SparkSession = ship(docs.sparkSession)
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = materialise(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word string, count long").groupBy("word").agg(F.sum("count").alias("count")), "words")
    of, outside = vocabulary(counts, vocab)
    n_docs = docs.count()
    c1 = np.array([outside + 1, 0, n_docs, *(c for c, _ in of)], float)
    sizes = np.array([1, 1, 1, *(n for _, n in of)], np.int64)
    if sizes.sum() > 1 << BITS:
        raise ValueError(f"{sizes.sum()} words do not fit an id of {BITS} bits")
    d1 = discounts(dict(of))
    kept = np.where(c1 <= K, d1[np.minimum(c1, K).astype(int)], 1.0) * c1
    kept[:3] = c1[:3]
    p = kept / (c1 * sizes).sum()
    p[UNK] += 1 - (p * sizes).sum()
    p1 = Steps(sizes, p)
    each = spark.createDataFrame([(int(c), float(x)) for c, x in zip(c1[3:], p[3:])], "count long, p double")
    own = spark.createDataFrame([(w, i, int(c1[i]), float(p[i])) for i, w in enumerate(("<unk>", "<s>", "</s>"))], "word string, id long, count long, p double")
    words, rows = _numbered(counts.where(F.col("count") >= (of[-1][0] if of else (1 << 62))))
    unigrams = materialise(words.join(F.broadcast(each), "count").select("word", "id", "count", "p").unionByName(own), "unigrams")
    release(spark, counts, rows)
    made, done = _postings_of(docs, unigrams, buckets, order)
    postings = bucketed(made, "postings", "bucket", max(2, buckets // 2))
    release(spark, *done)
    merged = postings.where("bucket >= 0").select("bucket", "keys", "tf").groupBy("bucket").applyInArrow(_merge(order, keep), "bucket int, keys binary, counts binary, of array<long>")
    ngrams = materialise(merged, "ngrams", ["bucket"] if keep else None)
    n = np.sum([r["of"] for r in ngrams.select("of").collect()] or [[0] * ((order - 1) * (K + 1))], axis=0).reshape(order - 1, K + 1)
    d = [discounts({r: int(x) for r, x in enumerate(of, 1)}) for of in n]
    return Model(unigrams, ngrams, p1, d, buckets, order), postings


def _total(heads: DataFrame, sums: DataFrame) -> DataFrame:
    blank = F.lit(None).cast("binary")
    heads = heads.where("bucket < 0").select("uid", "bucket", "docs", blank.alias("sums"), "nulls", "tf")
    out = keyed(heads.unionByName(sums.select("uid", "bucket", "docs", "sums", blank.alias("nulls"), blank.alias("tf"))), "uid", _gather, "doc_id long, n_tokens long, log_prob double")
    return out.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_tokens")))


def score(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob, perplexity of any documents under the model."""
    made, done = _postings_of(docs, model.unigrams, model.buckets, model.order)
    postings = materialise(made, "postings")
    release(docs.sparkSession, *done)
    blank = F.lit(None).cast("binary")
    left = postings.where("bucket >= 0").select("bucket", "uid", "keys", "docs", "tf", blank.alias("counts"))
    right = model.ngrams.select(F.col("bucket").cast("int").alias("bucket"), F.lit(-1).cast("long").alias("uid"), "keys", blank.alias("docs"), blank.alias("tf"), "counts")
    sums = left.unionByName(right).groupBy("bucket").applyInArrow(_score_others(model.p1, model.d, model.order), _SUMS)
    return _total(postings, sums)


def score_corpus(docs: DataFrame, vocab: int | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, log_prob, perplexity of every document under the model of all of them."""
    model, postings = train(docs, vocab, order, keep=False)
    sums = postings.where("bucket >= 0").select("bucket", "uid", "keys", "docs", "tf").groupBy("bucket").applyInArrow(_score(model.p1, model.d, order), _SUMS)
    return _total(postings, sums)

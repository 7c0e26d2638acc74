"""Exact n-gram Jaccard join by shared prefixes.

Texts are sets of word n-grams; texts of equal sets are one record. The n-grams have one order: by
their count in a sample of texts, then by hash. Two sets of sizes x and y with Jaccard >= t share at
least o = t / (1 + t) * (x + y) n-grams, so the first x - o + k of one and the first y - o + k of the other share at
least k = min(SHARED, o). Each record posts the longest such prefix. A list (the records that post one
n-gram) counts its pairs; those that reach k over all lists are candidates. In lists of more than brute records, those that
meet the first record of their list in SHARED lists are tied to it, and records that ties connect need no pairs, so
a cluster's don't grow as its square. Candidates and ties connect records to groups that every link lies in, and
within a group all sets are compared, in blocks of about TOKENS n-grams. The sample only sets the order, any of
which is right. Nothing is left to chance but equal 64-bit hashes of words, n-grams or sets.

Memory: a task holds the order (RANKED n-grams at most), the postings of a part of the n-grams (about ENTRIES, and one list at least)
with about PAIRS of their pairs at a time, or two blocks; links are counted where they are found and only a spanning forest of them
is kept, so no table grows as their number.

Defined results: a document is a doc_id and a text; repeated rows are one. classes() has a row for each, also for those
without a word, which are alone; rows with a null doc_id or text are in no class and op5 gives each a row with 0 links. A class is what
links connect, named by its least document; links counts the other documents of Jaccard >= threshold,
equal sets and other texts of the doc_id among them. jaccard_join names a set by its least doc_id, pairs each further
doc_id of the set with that one at 1.0, and doesn't pair a doc_id with itself; one doc_id with several texts may come
in a pair more than once. Texts count whole, however long. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, WordHash, broadcast_if_small, by_key, keyed, mix, ngrams, spans, word_hashes
from lodestone.session import materialise, release, ship

NGRAM = 3
THRESHOLD = 0.6
RECALL = 0.99
BRANCH = 2
#: Records of a list whose pairs are all counted.
BRUTE = 32
#: N-grams that a candidate pair shares in its prefixes.
SHARED = 4
#: Least and most texts whose n-grams are counted for the order, and between them the share of all texts, one in so many.
SAMPLE, SAMPLE_MOST, SAMPLE_SHARE = 20_000, 200_000, 12
#: N-grams of the order, those of the highest counts; the others come first, by hash.
RANKED = 4_000_000
#: Postings of a part, about, and n-grams that a task gathers before it sends their postings on.
ENTRIES, HELD = 500_000, 500_000
#: Pairs of postings counted at once, and counted pairs that are held before they are sent on.
PAIRS = 500_000
#: N-grams of a block, each record counting as RECORD more; and texts whose sets are made at once.
TOKENS, RECORD, TEXTS = 500_000, 400, 500
#: Incidence columns multiplied at once.
COLUMNS = 2048
_EPS = 1e-6


def survival(threshold: float, branch: int) -> float:
    """The greatest q with q = 1 - (1 - threshold * q)^branch: a pair at the threshold shares a sampled path of any length."""
    q = 1.0
    for _ in range(10_000):
        q = 1 - (1 - threshold * q) ** branch
    return q


def runs(threshold: float = THRESHOLD, recall: float = RECALL, branch: int = BRANCH) -> int:
    """Runs that a join by sampled paths would need for a recall; the join below doesn't sample."""
    q = survival(threshold, branch)
    if q < 0.01:
        raise ValueError(f"branch {branch} is too small for threshold {threshold}: paths die out")
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q))) if q < 1 else 1


class _Words(WordHash):
    """As WordHash, of 64 independent bits, and smaller."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def _set(text: str, n: int, cache: WordHash) -> np.ndarray:
    """The sorted n-grams of a text."""
    words = WORD.findall(text.lower())
    return np.unique(ngrams(word_hashes(words, cache), n)) if words else np.zeros(0, np.uint64)


def _key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.add.reduce(mix(s)) ^ np.uint64(len(s) << 40)], np.uint64))[0])


def _least(threshold: float, sizes: np.ndarray) -> np.ndarray:
    """N-grams that two sets of so many together share at the threshold."""
    return np.maximum(1, np.ceil(threshold / (1 + threshold) * sizes - _EPS)).astype(np.int64)


def prefix(threshold: float, size: np.ndarray) -> np.ndarray:
    """N-grams that a record posts: its longest prefix for any partner, which is that for the smallest one."""
    o = np.maximum(1, np.ceil(threshold * size - _EPS)).astype(np.int64)
    return np.minimum(size, size - o + np.minimum(SHARED, o))


def _planes(s: np.ndarray) -> bytes:
    """uint32 by planes of bytes, of which the high ones compress well."""
    return s.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int32)


def _parts(token: np.ndarray, parts: int) -> np.ndarray:
    """The part of a 32-bit token."""
    return ((token.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _token(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(16)).astype(np.uint32)


def _sampled(n: int, parts: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held))
            at = np.searchsorted(_parts(t, parts), np.arange(parts + 1))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array([t[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["part", "tokens"])

        for b in batches:
            for text in b.column(0):
                held.append(_token(_set(text.as_py(), n, cache)))
                size += len(held[-1])
                if size > HELD:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return fn


def _frequent(most: int):
    """The tokens of a part that occur twice or more, and how often; where those are over most, the most frequent, ties by token."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "part"):
            for lo, hi in spans(t.column("part").combine_chunks().to_numpy()):
                token, count = np.unique(np.frombuffer(b"".join(t.column("tokens").slice(lo, hi - lo).to_pylist()), np.uint32), return_counts=True)
                token, count = token[count > 1], np.minimum(count[count > 1], 65_535).astype(np.uint16)
                if len(token) > most:
                    at = np.sort(np.argsort(65_535 - count, kind="stable")[:most])
                    token, count = token[at], count[at]
                yield pa.RecordBatch.from_arrays([pa.array([token.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], ["tokens", "counts"])

    return fn


def sampled(documents: int) -> int:
    return min(SAMPLE_MOST, max(SAMPLE, documents // SAMPLE_SHARE))


def _order(clean: DataFrame, n: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that occur in several texts of the sample, and in how many; RANKED at most, as each task holds them."""
    parts = 16
    few = clean.where(F.pmod(F.xxhash64("body"), F.lit(max(1, documents // sampled(documents)))) == 0).select("text")
    rows = keyed(few.mapInArrow(_sampled(n, parts), "part int, tokens binary"), "part", _frequent(RANKED // parts), "tokens binary, counts binary", parts).collect()
    token, count = (np.frombuffer(b"".join(bytes(r[k]) for r in rows), d) for k, d in ((0, np.uint32), (1, np.uint16)))
    at = np.argsort(token)
    return token[at], count[at]


_POSTED = "part int, doc_id long, body long, key long, size int, tokens binary, keys binary, places binary, sizes binary"


def _post(n: int, threshold: float, parts: int, order):
    """A row for each document (tokens null), and the postings of a few thousand of them packed in a row for each part."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        token, count = order.value
        names = [x.split()[0] for x in _POSTED.split(", ")]
        docs: list[tuple[int, int, int, int]] = []
        sets: list[np.ndarray] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            doc, body, key, size = (np.array(c, d) for c, d in zip(zip(*docs), (np.int64, np.int64, np.uint64, np.int64)))
            part = (key % np.uint64(parts)).astype(np.int32)
            none = pa.nulls(len(doc), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(doc), pa.array(body), pa.array(key.view(np.int64)), pa.array(size.astype(np.int32)), none, none, none, none], names)
            s = np.concatenate(sets)
            if not len(s):
                return
            rank = np.zeros(len(s), np.uint64)
            if len(token):
                t = _token(s)
                at = np.minimum(np.searchsorted(token, t), len(token) - 1)
                rank = np.where(token[at] == t, count[at], 0).astype(np.uint64)
            s = (rank << np.uint64(48)) | (s >> np.uint64(16))
            end = np.cumsum(size)
            for a, b in zip((end - size).tolist(), end.tolist()):
                s[a:b].sort()
            place = np.arange(len(s)) - np.repeat(end - size, size)
            own = np.repeat(np.arange(len(size)), size)
            keep = place < prefix(threshold, size)[own]
            t, place, own = s[keep].astype(np.uint32), place[keep], own[keep]
            part = _parts(t, parts)
            at = np.argsort(part.astype(np.uint16) if parts < 65_536 else part, kind="stable")
            t, place, own, part = t[at], place[at], own[at], part[at]
            cut = np.searchsorted(part, np.arange(parts + 1))
            of = np.flatnonzero(cut[1:] > cut[:-1])
            slices = [slice(cut[p], cut[p + 1]) for p in of]
            nul = pa.nulls(len(of), pa.int64())
            packed = [[t[x].tobytes() for x in slices], [key[own[x]].tobytes() for x in slices], [_planes(place[x]) for x in slices], [_planes(size[own[x]]) for x in slices]]
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), nul, nul, nul, pa.nulls(len(of), pa.int32()), *(pa.array(c, pa.binary()) for c in packed)], names)

        for b in batches:
            for doc_id, body, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                s = _set(text.as_py(), n, cache)
                with np.errstate(over="ignore"):
                    # A text without a word is a record of its own.
                    key = _key(s) if len(s) else int(mix(mix(np.array([doc_id], np.int64).view(np.uint64)) ^ np.array([body], np.int64).view(np.uint64))[0])
                docs.append((doc_id, body, key, len(s)))
                sets.append(s)
                held += len(s) + 8
                if held > HELD:
                    yield from rows()
                    docs, sets, held = [], [], 0
        if docs:
            yield from rows()

    return fn


def _passing(place: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether a shared n-gram lies in the prefixes of the two, and the n-grams that they need."""
    o = _least(threshold, size[i] + size[j])
    k = np.minimum(SHARED, o)
    return (place[i] < size[i] - o + k) & (place[j] < size[j] - o + k), k


def _counted(rec: np.ndarray, n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of pairs (i, j, need) of postings: pairs a < b of the n records, how often they come and what they need.

    About PAIRS are counted at once, and sent on where as many different ones are held: a pair may then come again, and its counts add up.
    """
    none = np.zeros(0, np.int64)
    done, fresh, held = (none, none, none), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code, count, need = (np.concatenate(x) for x in zip(done, *fresh))
        at = np.argsort(code, kind="stable")
        code = code[at]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return code[first], np.add.reduceat(count[at], first), need[at[first]]

    for i, j, need in pairs:
        fresh.append((np.minimum(rec[i], rec[j]) * n + np.maximum(rec[i], rec[j]), np.ones(len(i), np.int64), need))
        held += len(i)
        if held >= PAIRS:
            done, fresh, held = merged(), [], 0
            if len(done[0]) >= PAIRS:
                yield done[0] // n, done[0] % n, *done[1:]
                done = none, none, none
    if held:
        done = merged()
    if len(done[0]):
        yield done[0] // n, done[0] % n, *done[1:]


def _near(rec: np.ndarray, place: np.ndarray, size: np.ndarray, rest: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, need) of each posting i with the rest that follow it in its list, in turns of about PAIRS."""
    starts = np.flatnonzero(rest > 0)
    for lo, hi in spans(np.cumsum(rest[starts], dtype=np.int64) // PAIRS):
        i, d = starts[lo:hi], 1
        while len(i):
            ok, need = _passing(place, size, i, i + d, threshold)
            ok &= rec[i] != rec[i + d]
            yield i[ok], i[ok] + d, need[ok]
            d += 1
            i = i[rest[i] >= d]


def listed(token: np.ndarray, key: np.ndarray, place: np.ndarray, size: np.ndarray, threshold: float, brute: int) -> tuple[Iterator[tuple], tuple]:
    """Of postings: pairs a < b of records, the n-grams they share in their prefixes and those they need, in turns whose
    counts add up; and the long lists as (key, list, place, size)."""
    if not len(token):
        return iter(()), (token, token, token, token)
    at = np.lexsort((place, key, size, token))
    token, key, place, size = token[at], key[at], place[at], size[at]
    # Copies of a set post the same.
    new = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])]
    token, key, place, size = token[new], key[new], place[new], size[new]
    # A list ends where the next size is too large for any partner before.
    edge = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (size[:-1] < threshold * size[1:] - _EPS), True])
    length = np.diff(edge)
    rest = (np.repeat(edge[1:], length) - np.arange(len(token)) - 1).astype(np.int32)
    long = np.repeat(length > brute, length)
    rest[long] = 0
    name = token[long].astype(np.int64) << 31 | np.repeat(size[edge[:-1]], length)[long]
    lists = key[long], name, place[long], size[long]
    ids, rec = np.unique(key, return_inverse=True)
    return ((ids[a], ids[b], count, need) for a, b, count, need in _counted(rec, len(ids), _near(rec, place, size, rest, threshold))), lists


def _cross(threshold: float):
    """Rows of long lists: the pairs of records that ties don't connect."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "list"):
            name, key, place, size, tied = (t.column(c).combine_chunks().to_numpy() for c in ("list", "key", "place", "size", "tied"))
            place, size = place.astype(np.int64), size.astype(np.int64)
            ids, rec = np.unique(key, return_inverse=True)

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for lo, hi in spans(name):
                    own = tied[lo:hi]
                    kinds, count = np.unique(own, return_counts=True)
                    most = kinds[np.argmax(count)]
                    # Each pair once: the records out of the largest tie with all that follow in an order that puts them first.
                    out = own != most
                    order = np.argsort(~out, kind="stable")
                    for x in range(int(out.sum())):
                        i, j = lo + order[x], lo + order[x + 1 :]
                        j = j[tied[j] != tied[i]]
                        ok, need = _passing(place, size, np.full(len(j), i), j, threshold)
                        if ok.any():
                            yield np.full(int(ok.sum()), i), j[ok], need[ok]

            for a, b, count, need in _counted(rec, len(ids), pairs()):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(count.astype(np.int32)), pa.array(need.astype(np.int32))], ["a", "b", "n", "need"])

    return fn


#: kind 0: a pair and how many n-grams it shares here and needs; 1: a posting (record a, place n) of the long list b; 2: a document (doc_id a, text b), its key,
#: the documents of that set and the least of them.
_FOUND = "kind byte, a long, b long, n int, need int, key long, size int, doc long, body long"


def _unpacked(part: pa.Table) -> tuple[np.ndarray, ...]:
    """token, key, place and size of the postings whose n-gram occurs in several; most occur once."""
    token = np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.uint32)
    at = np.argsort(token, kind="stable")
    same = token[at[1:]] == token[at[:-1]]
    at = at[np.r_[False, same] | np.r_[same, False]]
    key = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64)[at]
    place, size = (np.concatenate([_unplaned(x) for x in part.column(c).to_pylist()])[at] for c in ("places", "sizes"))
    return token[at], key, place, size


def _lists(threshold: float, brute: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _FOUND.split(", ")]

        def out(kind: int, a, b, n=None, need=None, key=None, size=None, doc=None, body=None) -> pa.RecordBatch:
            ints = [pa.nulls(len(a), pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (n, need, size)]
            longs = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x) for x in (key, doc, body)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), ints[0], ints[1], longs[0], ints[2], longs[1], longs[2]], names)

        for t in by_key(batches, "part"):
            for lo, hi in spans(t.column("part").combine_chunks().to_numpy()):
                part = t.slice(lo, hi - lo)
                bare = part.filter(part.column("tokens").is_null())
                if len(bare):
                    doc, body, key, size = (bare.column(c).combine_chunks().to_numpy() for c in ("doc_id", "body", "key", "size"))
                    at = np.lexsort((body, doc, key))
                    doc, body, key, size = doc[at], body[at], key[at], size[at]
                    new = np.r_[True, (doc[1:] != doc[:-1]) | (body[1:] != body[:-1]) | (key[1:] != key[:-1])]
                    doc, body, key, size = doc[new], body[new], key[new], size[new]
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    copies = np.diff(np.r_[first, len(key)])
                    of = np.repeat(first, copies)
                    yield out(2, doc, body, np.repeat(copies, copies), None, key, size, doc[of], body[of])
                part = part.filter(part.column("tokens").is_valid())
                if not len(part):
                    continue
                pairs, (x, name, where, sizes) = listed(*_unpacked(part), threshold, brute)
                del part
                for a, b, n, need in pairs:
                    yield out(0, a, b, n, need)
                if len(x):
                    yield out(1, x, name, where, size=sizes)

    return fn


def _with_sets(n: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in (whole.slice(k, TEXTS) for whole in batches for k in range(0, whole.num_rows, TEXTS)):
            at = b.schema.get_field_index("text")
            sets = pa.array([_set(x.as_py(), n, cache).tobytes() for x in b.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns) if k != at), sets], [*(x for x in b.schema.names if x != "text"), "tokens"])

    return fn


def overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first split of some sets with the others, or of all with all where split is 0."""
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.r_[True, every[1:] != every[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], np.cumsum(new[shared]) - 1
    a, b = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
    out = np.zeros((split or len(sets), len(sets) - split), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, (lo, lo + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[x:y], column[x:y] - lo] = 1
        out += m[a] @ m[b].T
    return out


def _compare(threshold: float, pairs: bool):
    """Rows of a job, two blocks of a group or one with itself: the pairs, or each record's links and one that links connect it with."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, "job"):
            job, key, weight, block, low, high = (t.column(c).combine_chunks().to_numpy() for c in ("job", "key", "copies", "block", "low", "high"))
            comp = t.column("rep").combine_chunks().to_numpy()
            tokens = t.column("tokens")
            out: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in spans(job):
                # Equal job hashes of several jobs are told apart.
                at = np.lexsort((key[lo:hi], block[lo:hi], high[lo:hi], low[lo:hi], comp[lo:hi])) + lo
                new = np.r_[True, (comp[at[1:]] != comp[at[:-1]]) | (low[at[1:]] != low[at[:-1]]) | (high[at[1:]] != high[at[:-1]])]
                for s in np.split(at, np.flatnonzero(new)[1:]):
                    # A document that came in several rows is one.
                    s = s[np.r_[True, key[s[1:]] != key[s[:-1]]]]
                    cross = low[s[0]] != high[s[0]]
                    split = int((block[s] == low[s[0]]).sum()) if cross else 0
                    if len(s) < 2 or cross and split in (0, len(s)):
                        continue
                    sets = [np.frombuffer(tokens[int(k)].as_py(), np.uint64) for k in s]
                    size = np.array([len(x) for x in sets], np.float64)
                    a, b = (np.arange(split), np.arange(split, len(s))) if cross else (np.arange(len(s)), np.arange(len(s)))
                    if size[a].max() < threshold * size[b].min() - _EPS:
                        continue
                    both = overlaps(sets, split).astype(np.float64)
                    sim = both / (size[a][:, None] + size[b][None] - both)
                    link = sim >= threshold
                    if not cross:
                        np.fill_diagonal(link, False)
                    if pairs:
                        i, j = np.nonzero(link if cross else np.triu(link))
                        found = key[s[a[i]]], key[s[b[j]]], sim[i, j]
                    else:
                        links = np.zeros(len(s), np.int64)
                        links[a] = link @ weight[s[b]].astype(np.float64)
                        if cross:
                            links[b] = weight[s[a]].astype(np.float64) @ link
                        label, old = np.arange(len(s)), None
                        while old is None or (label != old).any():
                            old = label
                            label = label.copy()
                            label[a] = np.minimum(label[a], np.where(link, label[b][None], len(s)).min(1))
                            label[b] = np.minimum(label[b], np.where(link, label[a][:, None], len(s)).min(0))
                        some = np.flatnonzero(links)
                        found = key[s[some]], key[s[label[some]]], links[some]
                    for column, x in zip(out, found):
                        column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b", "jaccard" if pairs else "links"])

    return fn


def body_hash(column: str = "text") -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64(F.col(column).cast("string"))


def joined(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, brute: int = BRUTE, pairs: bool = False) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The documents (doc_id, body, key of the set, copies: documents of the set, doc and first: the least of them), and the links of records.

    The latter as pairs (a, b, jaccard), or (a, b, links), a record's links in a job and one of its class. Also the tables that can be released once these are read.
    """
    spark = ship(docs.sparkSession)
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body_hash().alias("body"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    documents, chars = clean.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(12, math.ceil((chars or 0) / 14 / ENTRIES))
    order = spark.sparkContext.broadcast(_order(clean, n, documents))
    out = materialise(keyed(clean.mapInArrow(_post(n, threshold, parts, order), _POSTED), "part", _lists(threshold, brute), _FOUND, parts), "found")
    order.unpersist()
    release(spark)
    names = out.where("kind = 2").select(F.col("a").alias("doc_id"), F.col("b").alias("body"), "key", "size", F.col("n").alias("copies"), "doc", F.col("body").alias("first"))
    long = out.where("kind = 1").select(F.col("b").alias("list"), F.col("a").alias("key"), F.col("n").alias("place"), "size")
    first = long.withColumn("first", F.min("key").over(Window.partitionBy("list"))).where("key <> first")
    ties = materialise(first.groupBy("first", "key").count().where(F.col("count") >= SHARED).select(F.col("first").alias("a"), F.col("key").alias("b")), "ties")
    tied = groups(ties.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))).select(F.col("doc_id").alias("key"), F.col("rep").alias("tied"))
    marked = long.join(broadcast_if_small(tied, 24), "key", "left").withColumn("tied", F.coalesce("tied", "key"))
    met = out.where("kind = 0").select("a", "b", "n", "need").unionByName(keyed(marked, "list", _cross(threshold), "a long, b long, n int, need int"))
    near = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("need").alias("need")).where("n >= need").select("a", "b")
    group = materialise(groups(near.unionByName(ties).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))).select(F.col("doc_id").alias("key"), "rep"), "groups")
    release(spark)

    of = Window.partitionBy("rep")
    before = F.sum(F.col("size") + RECORD).over(of.orderBy("size", "key").rowsBetween(Window.unboundedPreceding, -1))
    one = names.where("doc_id = doc and body = first").join(broadcast_if_small(group, 24), "key")
    placed = one.withColumn("block", (F.coalesce(before, F.lit(0)) / TOKENS).cast("int"))
    members = materialise(placed.withColumn("blocks", F.max("block").over(of) + 1).select("doc_id", "body", "key", "copies", "rep", "block", "blocks"), "members")
    made = clean.join(broadcast_if_small(members, 40), ["doc_id", "body"])
    made = made.mapInArrow(_with_sets(n), "doc_id long, body long, key long, copies int, rep long, block int, blocks int, tokens binary")
    jobs = made.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "block", "key", "copies", "tokens")
    jobs = jobs.withColumn("job", F.xxhash64("rep", "low", "high")).select("job", "rep", "low", "high", "block", "key", "copies", "tokens")
    links = materialise(keyed(jobs, "job", _compare(threshold, pairs), "a long, b long, jaccard double" if pairs else "a long, b long, links long"), "links")
    release(spark, members, group)
    return names, links, [out, links]


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, brute: int = BRUTE) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, body, class_id, class_body, links) of every document. Also the tables that can be released once this is written."""
    names, links, done = joined(docs, threshold, n, brute)
    label = groups(links.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).distinct()).select(F.col("doc_id").alias("key"), "rep")
    count = links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("others"))
    least = names.where("doc_id = doc and body = first").join(broadcast_if_small(label, 24), "key").select("key", "rep", "doc", "first")
    name = least.groupBy("rep").agg(F.min(F.struct("doc", "first")).alias("least"))
    linked = materialise(least.select("key", "rep").join(name, "rep").join(count, "key").select("key", "least", "others"), "classes")
    out = names.join(broadcast_if_small(linked, 40), "key", "left")
    return out.select("doc_id", "body", F.coalesce("least.doc", "doc").alias("class_id"), F.coalesce("least.first", "first").alias("class_body"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")), [*done, linked]


def links(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, brute: int = BRUTE) -> DataFrame:
    """A row for each document: doc_id, class_id (the least doc_id that links connect it with) and links, the other documents whose n-gram sets have a Jaccard of at least threshold with its."""
    out, _ = classes(docs, threshold, n, brute)
    doc_id = F.col("doc_id").cast("long")
    alone = docs.where("doc_id is null or text is null").select(doc_id.alias("doc_id"), doc_id.alias("class_id"), F.lit(0).cast("long").alias("links"))
    return out.select("doc_id", "class_id", "links").unionByName(alone)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, brute: int = BRUTE) -> DataFrame:
    """Pairs (doc_a < doc_b, jaccard) of documents whose n-gram sets have a Jaccard of at least threshold. They grow as the square of a class; links() doesn't."""
    names, pairs, _ = joined(docs, threshold, n, brute, True)
    first = names.where("doc_id = doc and body = first").select("key", "doc")
    ends = pairs.join(first.toDF("a", "doc_a"), "a").join(first.toDF("b", "doc_b"), "b")
    other = names.where("doc_id <> doc").select(F.col("doc").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return ends.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), "jaccard").where("doc_a <> doc_b").unionByName(other)


def copies(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, body): the texts that have a text of lesser (doc_id, body) in their class."""
    out, done = classes(docs, **how)
    lost = materialise(out.where("doc_id <> class_id or body <> class_body").select("doc_id", "body"), "lost")
    release(docs.sparkSession, *done)
    return lost


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, rep) of all documents in a pair; rep is the least doc_id that pairs connect it with.

    Labels spread along pairs and halve their way by pointer jumping; each round is written out.
    """
    edges = materialise(pairs.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).where("a <> b"), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    held = label = materialise(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("rep")), "labels")
    while True:
        seen = both.join(label.select(F.col("a").alias("b"), F.col("rep").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        spread = label.join(seen, "a").select("a", F.least("rep", "other").alias("new"), "rep")
        jump = spread.join(label.select(F.col("a").alias("new"), F.col("rep").alias("far")), "new", "left").select("a", F.least("new", F.coalesce("far", "new")).alias("rep"), (F.least("new", F.coalesce("far", "new")) < F.col("rep")).alias("moved"))
        step = materialise(jump, "labels")
        release(step.sparkSession, held)
        held, label = step, step.select("a", "rep")
        if step.where("moved").isEmpty():
            return label.select(F.col("a").alias("doc_id"), "rep")

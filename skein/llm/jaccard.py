"""Exact similarity join on word shingles, by T-occurrence search with DivideSkip.

Two documents link when the Jaccard similarity of their sets of word shingles
reaches the threshold. The steps, each exact:

1. Each document becomes a set of 64-bit shingle hashes; equal sets are one class
   from here on, so copies are never expanded.
2. Prefix counting. Two linked sets share at least l of the first n - T + l
   hashes of either (T the least overlap for a set of n). The postings of these
   prefixes are dealt out by hash; a document stays in play only if enough of
   its prefix also occurs in some other document of a fitting size. A task
   reports what it can settle among its own documents, and sends each hash and
   size once, so a hash that very many documents have is pre-aggregated.
3. What stays in play is tied into blocks through shared prefix hashes and
   fitting sizes; linked documents are always in one block.
4. In a block, T-occurrence search: the inverted lists of a document's shingles
   are divided into long and short ones; the short ones are merged with a heap,
   and what occurs there often enough is looked up in the long ones by binary
   search. Lists hold only leaders: a document linked to a leader joins it, and as
   Jaccard distance is a metric, the members of leaders beyond twice the
   threshold distance can't be linked to it, so a dense group costs little more than
   one search a document. A block with too many shingles for one task is cut by
   size into bands, of which only neighbours can be linked, and a band that is
   still too large into parts, of which each pair is a task.
5. Links become components. Where each document's number of links is asked for,
   the search of step 4 runs over all sets of a block instead of its leaders, and
   each link counts once for every document of the class at its other end.

Null texts and texts without words have the empty set and link with nothing.
Rows with one id count as one document. Rows with a null id have no component.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled, ship, table, width
from .components import components
from .lexing import chunks, plain_words, spread

SHINGLE, PERCENT = 5, 80
#: Shingles that are in one task of step 4 at most (a larger single document aside).
BLOCK_SHINGLES = 2_000_000
#: Prefix hashes that a task gathers before it sends them on.
FLUSH = 1_000_000
#: Of the overlap, the share that step 2 asks the prefixes for.
PREFIX_SHARE = 0.3
_SCALE = 2000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, words, off = plain_words(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))[codes]
    n = len(hashed) - size + 1
    acc = np.full(max(n, 0), 0x51ED270B76E1D3F5, np.uint64)
    for k in range(size if n > 0 else 0):
        acc = (acc ^ hashed[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(31)
    out, none = [], np.zeros(0, np.uint64)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a >= size:
            x = np.sort(acc[a : b - size + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        else:  # the whole sequence is the one shingle
            out.append(np.array([xxhash.xxh3_64_intdigest(hashed[a:b].tobytes(), 7)], np.uint64) if b > a else none)
    return out


def _share(n, percent: int):
    return -(-percent * n // 100)


def _extra(n):
    return np.maximum(1, np.floor(PREFIX_SHARE * n)).astype(np.int64)


def prefix_size(n, percent: int, extra):
    """How many of a set's n smallest hashes are looked at, for two linked sets to share `extra` of them."""
    return np.minimum(n, n - _share(n, percent) + extra)


def _keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """48 bits of a hash above 16 bits of the logarithm of the set's size."""
    return (hashes & ~np.uint64(0xFFFF)) | (np.log2(sizes) * _SCALE).astype(np.uint64)


def _near(keys: np.ndarray, percent: int) -> np.ndarray:
    """For sorted keys, whether each has the hash of the one before it and a fitting size."""
    same = (keys[1:] >> np.uint64(16)) == (keys[:-1] >> np.uint64(16))
    return same & (keys[1:] - keys[:-1] <= np.uint64(math.floor(_SCALE * math.log2(100 / percent)) + 1))


_BLOBS = "bucket int, kind int, a binary, b binary, c binary"


def _blob(bucket: int, kind: int, *arrays) -> pa.RecordBatch:
    cols = [x.tobytes() if isinstance(x, np.ndarray) else x for x in arrays]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([c], pa.binary()) for c in cols)], ["bucket", "kind", "a", "b", "c"])


def _by_bucket(hashes: np.ndarray, buckets: int):
    """The order that puts hashes by bucket, and where each bucket begins in it."""
    b = ((hashes & np.uint64(0xFFFF)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def _bucketed(batches):
    """Per bucket, by kind, the blobs of rows that come sorted by bucket."""
    now, held = None, defaultdict(list)
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != now and held:
                yield now, held
                held = defaultdict(list)
            now = r["bucket"]
            held[r["kind"]].append((r["a"], r["b"], r["c"]))
    if held:
        yield now, held


def _joined(blobs, k: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x[k] for x in blobs), dtype)


def _dealt(blobs: DataFrame) -> DataFrame:
    return blobs.repartition(width(blobs.sparkSession), "bucket").sortWithinPartitions("bucket")


ENTRY, INFO, COUNT, NAMELESS, EDGE = range(5)


def prefix_counts(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row (doc_id, n, fp) for each row of docs, and rows (slot, ids, hits) with packed counts of shared prefix hashes."""
    slots = width(docs.sparkSession)
    buckets = min(1 << 16, 4 * width(docs.sparkSession))

    def send(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() if TaskContext.get() else 0
        prefixes, owners, sizes, held = [], [], [], 0

        def flushed():
            h, o, n = (np.concatenate(x) for x in (prefixes, owners, sizes))
            order, cuts = _by_bucket(h, buckets)
            key = _keys(h, n)
            local = defaultdict(int)
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if not len(at):
                    continue
                at = at[np.argsort(key[at], kind="stable")]
                k = key[at]
                near = _near(k, percent)
                seen = np.append(near, False) | np.append(False, near)
                mine, count = np.unique(o[at[seen]], return_counts=True)
                for d, c in zip(mine.tolist(), count.tolist()):
                    local[d] += c
                yield _blob(b, ENTRY, k[~seen], o[at[~seen]], np.unique(k[seen]))
            if local:
                yield _blob(turn % buckets, COUNT, np.fromiter(local.keys(), np.int64), np.fromiter(local.values(), np.int64), b"")

        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, size)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                fps = b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x, no in zip(sets, null) if not no)
                turn += 1
                yield _blob(turn % buckets, INFO, ids[~null], n[~null], fps)
                if null.any():
                    yield _blob(turn % buckets, NAMELESS, n[null], b"", b"")
                most = prefix_size(n, percent, _extra(n))
                for i in np.flatnonzero(~null & (n > 0)).tolist():
                    prefixes.append(sets[i][: most[i]])
                used = ~null & (n > 0)
                owners.append(np.repeat(ids[used], most[used]))
                sizes.append(np.repeat(n[used], most[used]))
                held += int(most[used].sum())
                if held >= FLUSH:
                    yield from flushed()
                    prefixes, owners, sizes, held = [], [], [], 0
        if held:
            yield from flushed()

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("slot", pa.int32()), ("ids", pa.binary()), ("hits", pa.binary())])

    def rows(*given):
        size = len(next(x for x in given if x is not None))
        cols = [pa.nulls(size, f.type) if x is None else pa.array(x, f.type) for x, f in zip((*given, *[None] * (len(schema) - len(given))), schema)]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    def packed(counted):
        ids, hits = _summed(np.concatenate([x for x, _ in counted]), np.concatenate([x for _, x in counted]))
        slot = ids % slots
        for k in np.unique(slot).tolist():
            yield rows(None, None, None, [k], [ids[slot == k].tobytes()], [hits[slot == k].tobytes()])

    def count(batches):
        counted, waiting = [], 0
        for _, held in _bucketed(batches):
            for a, b, c in held[INFO]:
                yield rows(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), [c[i : i + 16] for i in range(0, len(c), 16)])
            for a, _, _ in held[NAMELESS]:
                yield rows(None, np.frombuffer(a, np.int64))
            for a, b, _ in held[COUNT]:
                counted.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))
                waiting += len(counted[-1][0])
            if held[ENTRY]:
                own = _joined(held[ENTRY], 0, np.uint64)
                keys = np.concatenate([own, _joined(held[ENTRY], 2, np.uint64)])
                order = np.argsort(keys, kind="stable")
                near = _near(keys[order], percent)
                seen = np.zeros(len(keys), bool)
                seen[order] = np.append(near, False) | np.append(False, near) if len(keys) else False
                ids, hits = np.unique(_joined(held[ENTRY], 1, np.int64)[seen[: len(own)]], return_counts=True)
                counted.append((ids, hits))
                waiting += len(ids)
            if waiting > FLUSH:
                yield from packed(counted)
                counted, waiting = [], 0
        if waiting:
            yield from packed(counted)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return _dealt(texts.mapInArrow(send, _BLOBS)).mapInArrow(count, "doc_id bigint, n bigint, fp binary, slot int, ids binary, hits binary")


def _summed(ids: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sum of each one's hits."""
    once, back = np.unique(ids, return_inverse=True)
    return once, np.bincount(back, hits, len(once)).astype(np.int64)


def hit_sums(packed: DataFrame) -> DataFrame:
    """(doc_id, hits) of the packed counts (slot, ids, hits)."""

    def done(held):
        ids, hits = _summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits)], ["doc_id", "hits"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for slot, ids, hits in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if slot != now and held:
                    yield done(held)
                    held = []
                now = slot
                held.append((np.frombuffer(ids, np.int64), np.frombuffer(hits, np.int64)))
        if held:
            yield done(held)

    return packed.repartition(width(packed.sparkSession), "slot").sortWithinPartitions("slot").mapInArrow(run, "doc_id bigint, hits bigint")


def block_edges(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): each document tied to the first of those that share a hash of its prefix and have fitting sizes."""
    buckets = min(1 << 16, 4 * width(sets.sparkSession))

    def stars(keys, owners):
        """Sorted keys' owners, tied run by run to the first; and the keys with the first of their run."""
        order = np.argsort(keys, kind="stable")
        k, o = keys[order], owners[order]
        run = np.cumsum(np.append(True, ~_near(k, percent))) - 1 if len(k) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(k) else run
        centre = o[first][run]
        return k, centre, np.unique(np.stack([centre, o], axis=1)[centre != o], axis=0)

    def send(batches):
        prefixes, owners, sizes, held = [], [], [], 0

        def flushed():
            h, o, n = np.concatenate(prefixes), np.repeat(owners, list(map(len, prefixes))), np.repeat(sizes, list(map(len, prefixes)))
            order, cuts = _by_bucket(h, buckets)
            key = _keys(h, n)
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    k, centre, edges = stars(key[at], o[at])
                    once = np.append(True, k[1:] != k[:-1])
                    yield _blob(b, ENTRY, k[once], centre[once], b"")
                    if len(edges):
                        yield _blob(b, EDGE, np.ascontiguousarray(edges[:, 0]), np.ascontiguousarray(edges[:, 1]), b"")

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(raw, np.uint64)
                x = x[: int(prefix_size(len(x), percent, 1))]
                prefixes.append(x)
                owners.append(key)
                sizes.append(len(raw) // 8)
                held += len(x)
                if held >= FLUSH:
                    yield from flushed()
                    prefixes, owners, sizes, held = [], [], [], 0
        if held:
            yield from flushed()

    def tie(batches):
        for _, held in _bucketed(batches):
            _, _, edges = stars(_joined(held[ENTRY], 0, np.uint64), _joined(held[ENTRY], 1, np.int64))
            local = np.stack([_joined(held[EDGE], 0, np.int64), _joined(held[EDGE], 1, np.int64)], axis=1)
            every = np.unique(np.concatenate([edges.reshape(-1, 2), local]), axis=0)
            if len(every):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(every[:, 0])), pa.array(np.ascontiguousarray(every[:, 1]))], ["a", "b"])

    return _dealt(sets.select("doc_id", "n", "hashes").mapInArrow(send, _BLOBS)).mapInArrow(tie, "a bigint, b bigint").distinct()


#: From so many postings on, short lists are merged by one sort of all of them instead of with a heap.
HEAPED = 1000


def merged(lists: list[list[int]]):
    """(number, times) of the numbers in ascending lists."""
    if sum(map(len, lists)) <= HEAPED:
        for number, times in groupby(heapq.merge(*lists)):
            yield number, sum(1 for _ in times)
    else:
        number, times = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]), return_counts=True)
        yield from zip(number.tolist(), times.tolist())


class Lists:
    """Inverted lists from shingle to ascending numbers of sets, searched by DivideSkip."""

    #: Weighs binary look-ups against merging when lists are divided.
    MU = 0.02

    def __init__(self):
        self.lists: dict[int, list[int]] = defaultdict(list)

    def add(self, number: int, shingles: list[int]) -> None:
        """Puts a set, whose number must be greater than all before."""
        for s in shingles:
            self.lists[s].append(number)

    def search(self, shingles: list[int], least: int) -> list[tuple[int, int]]:
        """(number, overlap) of each set that shares at least `least` of the shingles."""
        get = self.lists.get
        found = sorted(filter(None, map(get, shingles)), key=len)
        if len(found) < least:
            return []
        long = min(least - 1, int(least / (self.MU * math.log2(len(found[-1]) + 1) + 1)), sum(len(x) > 1 for x in found))
        short, skipped = found[: len(found) - long], found[len(found) - long :]
        out = []
        for number, overlap in merged(short):
            if overlap < least - long:
                continue
            left = long
            for x in skipped:
                if overlap + left < least:
                    break
                at = bisect_left(x, number)
                overlap += at < len(x) and x[at] == number
                left -= 1
            if overlap >= least:
                out.append((number, overlap))
        return out


def block_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that tie together all linked sets of a block; not every link among sets that are tied already."""
    loose = 2 * percent - 100
    sizes = [len(x) for x in sets]
    _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[back] > 1  # a shingle of one set only adds to no overlap
    cuts = np.cumsum([0, *sizes])
    tokens = [back[a:b][shared[a:b]] for a, b in zip(cuts, cuts[1:])]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links, lists, members = [], Lists(), {}
    reaches = lambda overlap, i, j, p: 100 * overlap >= p * (sizes[i] + sizes[j] - overlap)

    def tie(i, j):
        links.append((ids[i], ids[j]))
        root[find(i)] = find(j)

    for i in range(len(ids)):
        if not sizes[i]:
            continue
        mine = tokens[i].tolist()
        near = [(o, j) for j, o in lists.search(mine, max(1, _share(sizes[i], loose))) if reaches(o, i, j, loose)]
        near.sort(key=lambda x: (-x[0], x[1]))
        home = None
        for o, j in near:
            if reaches(o, i, j, percent):
                if home is None:
                    home = j
                if find(i) != find(j):
                    tie(i, j)
        for _, j in near:
            if find(i) != find(j):
                for k in members[j]:
                    if 100 * min(sizes[i], sizes[k]) >= percent * max(sizes[i], sizes[k]) and reaches(len(np.intersect1d(tokens[i], tokens[k], assume_unique=True)), i, k, percent):
                        tie(i, k)
                        break
        if home is None:
            members[i] = []
            lists.add(i, mine)
        else:
            members[home].append(i)
    return links


def block_counts(sets: list[np.ndarray], weights: np.ndarray, percent: int, ours) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (as places in `sets`) that tie together all linked sets, and for each set the weight of those it is linked with.

    ours(i, js): which of the links of i with js count here.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    _, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(back, kind="stable")
    postings = owner[order]  # the inverted lists one after the other, each ascending
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # of each shingle of each set in its list
    first = (np.cumsum(times) - times)[back]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    counts, root, tied = np.zeros(n, np.int64), list(range(n)), []

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        a, b = first[cuts[i] : cuts[i + 1]], place[cuts[i] : cuts[i + 1]]  # the sets before this one in its lists
        some = b > a
        a, b = a[some], b[some]
        least = max(1, int(_share(sizes[i], percent)))
        if len(a) < least:
            continue
        by = np.argsort(b - a, kind="stable")
        a, b = a[by], b[by]
        size = b - a
        long = min(least - 1, int(least / (Lists.MU * math.log2(int(size[-1]) + 1) + 1)), int((size > 1).sum()))
        cut = len(a) - long
        found = postings[spread(size[:cut], a[:cut])]
        js, overlap = np.unique(found, return_counts=True) if len(found) < i else (np.arange(i), np.bincount(found, minlength=i))
        left = long
        keep = (overlap > 0) & (overlap + left >= least)
        js, overlap = js[keep], overlap[keep]
        for lo, hi in zip(a[cut:].tolist(), b[cut:].tolist()):
            if not len(js):
                break
            held = postings[lo:hi]
            at = np.searchsorted(held, js)
            overlap = overlap + ((at < hi - lo) & (held[np.minimum(at, hi - lo - 1)] == js))
            left -= 1
            keep = overlap + left >= least
            if not keep.all():
                js, overlap = js[keep], overlap[keep]
        js = js[100 * overlap >= percent * (sizes[i] + sizes[js] - overlap)]
        for j in js.tolist():
            if find(i) != find(j):
                tied.append((i, j))
                root[find(i)] = find(j)
        js = js[ours(i, js)]
        counts[i] += weights[js].sum()
        counts[js] += weights[i]
    return tied, counts


def counted_links(sets: DataFrame, blocks: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links as those of `links`; and rows (fp, linked): parts of the number of documents that each class is linked with.

    classes has fp, the document `rep` that stands for it, and weight, the number of its documents.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("fp", pa.binary()), ("linked", pa.int64())])

    def run(batches):
        now, held = None, []

        def done():
            if len(held) < 2:
                return
            ids, fps, raw, weights, upper, mine = zip(*held)
            weights, upper, mine = np.array(weights, np.int64), np.array(upper), np.array(mine)
            # sets meet in several tasks; their link counts where the band is the upper of the smaller set, for just their two parts
            ours = lambda i, js: (upper[i] | upper[js]) & (np.minimum(mine[i], mine[js]) == now[1]) & (np.maximum(mine[i], mine[js]) == now[2])
            tied, counts = block_counts([np.frombuffer(x, np.uint64) for x in raw], weights, percent, ours)
            if tied:
                a, b = ([ids[p] for p in x] for x in zip(*tied))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())], schema=schema)
            at = np.flatnonzero((counts > 0) & (weights > 0))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array([fps[p] for p in at.tolist()], pa.binary()), pa.array(counts[at])], schema=schema)

        for batch in batches:
            for block, i, j, doc, fp, raw, weight, upper, mine in zip(*(batch.column(k).to_pylist() for k in range(9))):
                if (block, i, j) != now:
                    yield from done()
                    now, held = (block, i, j), []
                if not (held and held[-1][:2] == (doc, fp)):
                    held.append((doc, fp, raw, weight, upper, mine))
        yield from done()

    # a set counts for the class only in the row of its own document
    weight = F.when(F.col("rep") == F.col("doc_id"), F.col("weight")).otherwise(0).cast("long")
    sizes = sets.select("doc_id", "fp", "n").distinct().join(blocks, "doc_id").join(classes.select("fp", "rep", "weight"), "fp")
    sizes = sizes.select("doc_id", "fp", "n", "block", weight.alias("weight"))
    rows = _tasks(sets.drop("n"), sizes, percent).select("block", "i", "j", "doc_id", "fp", "hashes", "weight", "upper", "mine")
    return rows.repartition(width(sets.sparkSession), "block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id", "fp").mapInArrow(run, "a bigint, b bigint, fp binary, linked bigint")


def _tasks(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The sets of each task (block, i, j), with `mine`, the part of each, and whether the task's band is the `upper` one of its two.

    sizes has block, n and columns that name rows of sets; any others are kept.
    """
    keep = [c for c in sizes.columns if c not in ("n", "block")]
    # linked sets lie in one band of sizes or in neighbouring ones, as a band is a little wider than they may differ
    band = F.floor(F.log("n") / math.log(100.01 / percent)).cast("int")
    large = sizes.groupBy("block").agg((F.sum("n") > BLOCK_SHINGLES).alias("large"))
    bands = F.when(F.col("large"), F.array(band, band + 1)).otherwise(F.array(F.lit(-1)))
    sizes = sizes.join(large, "block").select(*keep, "n", "block", F.explode(bands).alias("band")).withColumn("upper", (F.col("band") == -1) | (F.col("band") > band))
    parts = sizes.groupBy("block", "band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    sizes = sizes.join(parts, ["block", "band"]).withColumn("mine", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "mine").alias("i"), F.greatest(x, "mine").alias("j"))))
    tasks = sizes.select(*keep, "upper", "mine", F.xxhash64("block", "band").alias("block"), pair.alias("pair")).select(*keep, "upper", "mine", "block", "pair.i", "pair.j")
    return tasks.join(sets, [c for c in keep if c in sets.columns])


def links(sets: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links within blocks, enough to connect all that are linked."""
    spark = sets.sparkSession
    sets = sets.select("doc_id", "n", "hashes")
    rows = _tasks(sets.drop("n"), sets.select("doc_id", "n").join(blocks, "doc_id"), percent).select("block", "i", "j", "doc_id", "hashes")

    def run(batches):
        now, ids, sets = None, [], []

        def done():
            found = block_links(ids, sets, percent) if len(ids) > 1 else []
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(5)]
            for block, i, j, doc, raw in zip(*cols):
                if (block, i, j) != now:
                    yield from done()
                    now, ids, sets = (block, i, j), [], []
                x = np.frombuffer(raw, np.uint64)
                if not (ids and ids[-1] == doc and np.array_equal(sets[-1], x)):
                    ids.append(doc)
                    sets.append(x)
        yield from done()

    return rows.repartition(width(spark), "block", "i", "j").sortWithinPartitions("block", "i", "j", "doc_id").mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs; and if asked for n_links, how many other documents link with it.

    Different texts of one id have links of their own, each counting for itself.
    """
    if not 50 < percent <= 100:
        raise ValueError("the threshold must be above 50 and at most 100 percent")
    ship(docs.sparkSession)
    counted = settled(prefix_counts(docs, size, percent), "shingle-counts")
    info = counted.where("n is not null").select("doc_id", "n", "fp")
    hits = hit_sums(counted.where("slot is not null").select("slot", "ids", "hits"))
    classes = info.where("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), *([F.count_distinct("doc_id").alias("weight")] if count_links else []))
    partner = F.ceil(F.col("n") * percent / 100)  # the least size of a linked set
    need = F.greatest(F.lit(1), F.floor(PREFIX_SHARE * partner))
    play = classes.join(hits.withColumnRenamed("doc_id", "rep"), "rep").where(F.col("hits") >= need).select(F.col("rep").alias("doc_id")).distinct()

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sets = shingle_sets(texts, size)
                raw = [x.tobytes() for x in sets]
                fps = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(raw, pa.binary()), pa.array(fps, pa.binary())], ["doc_id", "n", "hashes", "fp"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    sets = settled(texts.join(play, "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, n bigint, hashes binary, fp binary").where("n > 0"), "shingle-sets")
    blocks = components(block_edges(sets, percent)).select(F.col("node").alias("doc_id"), F.col("component").alias("block"))
    found = settled(counted_links(sets, blocks, classes, percent), "links") if count_links else links(sets, blocks, percent)
    tied = components(found.select("a", "b"))
    reps = classes.join(tied.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = info.join(reps, "fp", "left").groupBy("doc_id").agg(F.min("component_id").alias("c"))
    # rows with one id are one document, so each row takes the smallest component of its id
    final = info.join(out, "doc_id", "left")
    cols = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("c")), F.col("doc_id")).alias("component_id")]
    if count_links:
        others = found.where("fp is not null").groupBy("fp").agg(F.sum("linked").alias("linked"))
        per = classes.join(others, "fp", "left").select("fp", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        final = final.join(per, "fp", "left")
        cols.append(F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return final.select(*cols)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, and the number of its links."""
    return join(table(spark, sf_dir, "documents"), count_links=True)

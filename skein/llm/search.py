"""Exact top-k search: BM25 over sharded inverted indexes, with block-max WAND pruning.

Every task builds inverted indexes over its own texts (shards of at most
SHARD_BYTES and SHARD_DOCS). A shard's documents are ordered by kind (clusters by
the common terms they have), then length, and each kind is cut into blocks; of each
term and block the greatest score is kept. Statistics (documents, mean length,
document frequencies) are counted over all documents first, so all shards score
alike and their results merge exactly. Query terms are numbered once; a shard looks
all of them up at once.

Queries are taken TILE_ROWS at a time, alike ones together. A block in which the
block maxima of a query's terms together stay below the query's threshold is
skipped. In each other block terms that many of the tile's queries and of the
block's documents have are scored by a matrix product; the pivot is the rarer term
at which the best score so far in the block and the cumulated block maxima pass a
share (PIVOT) of the threshold. A document without a term from the pivot on can't
reach the threshold, so only the postings from the pivot on are opened, for all
queries of a tile at once. Documents whose score so far and the maxima of the
unopened terms reach the threshold are completed from their own lists of terms, the
most promising ones first. The threshold is the k-th best score known: it rises as
documents are completed and is carried over to a task's next shards. A first round
over every SEED_SHARE-th document (by a hash of its id) gives the threshold to begin
with; where k documents have a query's very text, its score for itself is one too.
Queries with the same terms are searched once.

A query's terms count once each. Scores are rounded to 6 decimals; ties go by
ascending id. Texts are cut into lower-case runs of letters and digits. Null and
empty texts match nothing and, as queries, give no rows. Rows with a null id
aren't found; rows with one id are found as often as they occur. A text longer
than SHARD_BYTES makes a shard of its own, whole; a query of any length is one
row, of which a shard keeps the block maxima at once. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settled, shared_folder, ship, table, width
from .files import folder_files, opened
from .lexing import buffer_of, chunks, distinct_words, runs, spread, words_array
from .memory import lean

TOP, K1, B = 10, 1.2, 0.75
#: Bytes of text and documents in a shard, documents in a block (two to this power), queries read and queries scored at once.
SHARD_BYTES, SHARD_DOCS, BLOCK_BITS, QUERY_ROWS, TILE_ROWS = 32 << 20, 16384, 10, 2048, 256
#: Bytes of text of which terms are cut out at once; one in how many documents the first round takes.
COUNT_BYTES, SEED_SHARE = 6 << 20, 16
#: A term has a row in a shard's table if one in so many documents has it; clusters, and the most frequent terms that they go by, if one in so many has them.
TABLE_SHARE, KINDS, KIND_TERMS, KIND_SHARE = 64, 8, 256, 32
#: Products in a matrix that cost as much as one posting.
DENSE = 192
#: Postings that are added up at once.
POSTINGS = 1 << 16
POSTING = np.dtype([("doc", np.int32), ("impact", np.float32)])
#: Cells of a shard's table, which bounds its memory: beyond them the next frequent terms are treated as the rarer ones.
TABLE_CELLS = 1 << 24
#: Share of the threshold that may stay unopened. Bounds are sums in single precision, so scores this near below the threshold are looked at too.
PIVOT, SLACK, SHARE_SLACK, TINY = 0.2, 1e-5, 1e-3, 1e-30

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(text, term) codes: the text of each term, its code, and the distinct terms."""
    data, off = buffer_of(pc.utf8_lower(texts))
    kept = _TERM[data]
    starts, ends = runs(kept, off)
    codes, values = distinct_words(words_array(data, kept, ends - starts))
    return np.searchsorted(off, starts, "right") - 1, codes, values


def _kinds(term: np.ndarray, doc: np.ndarray, common: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A cluster for each document, by the common terms it has, and the clusters' centres: so blocks hold documents alike."""
    has = np.zeros((n, len(common)), np.float32)
    place = np.full(int(term.max()) + 1 if len(term) else 0, -1)
    place[common] = np.arange(len(common))
    at = np.flatnonzero(place[term] >= 0)
    has[doc[at], place[term[at]]] = 1
    has /= np.maximum(np.linalg.norm(has, axis=1, keepdims=True), 1)
    centre = has[:1]
    for _ in range(KINDS - 1):
        centre = np.concatenate([centre, has[(has @ centre.T).max(1).argmin()][None]])
    for _ in range(3):
        kind = (has @ centre.T).argmax(1)
        for c in range(KINDS):
            if (kind == c).any():
                centre[c] = has[kind == c].mean(0)
    return kind, centre


def _edges(sizes: np.ndarray) -> np.ndarray:
    """Where blocks begin, and the end: each cluster is cut evenly into blocks of at most two to the power BLOCK_BITS."""
    parts = -(-sizes >> BLOCK_BITS)
    of = np.repeat(np.arange(len(sizes)), parts)
    step = np.arange(len(of)) - (np.cumsum(parts) - parts)[of]
    return np.append((np.cumsum(sizes) - sizes)[of] + step * sizes[of] // np.maximum(parts[of], 1), sizes.sum())


def _postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(term, text, times) of each distinct pair by term, then text; the terms; and the number of words of each text. Texts are cut a part at a time."""
    _, off = buffer_of(texts)
    found, names, length, at, base = [], [], [], 0, 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + COUNT_BYTES, "right")) - 1)
        text, code, terms = terms_of(texts.slice(at, end - at))
        length.append(np.bincount(text, minlength=end - at))
        text += code * np.int64(end - at)
        del code
        key, times = np.unique(text, return_counts=True)
        del text
        found.append(((key // (end - at) + base).astype(np.int32), (key % (end - at) + at).astype(np.int32), times.astype(np.int32)))
        names.append(terms)
        at, base = end, base + len(terms)
    if not names:
        return *(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.binary()), np.zeros(0, np.int64)
    again, terms = distinct_words(pa.concat_arrays(names))
    term, text, times = (np.concatenate(x) for x in zip(*found))
    found.clear()
    term = again[term]
    order = np.argsort(term, kind="stable")  # the parts follow one another, so texts ascend within each term
    return term[order].astype(np.int64), text[order].astype(np.int64), times[order], terms, np.concatenate(length)


def _cut(least: float) -> float:
    """What a score bound must reach for a score of `least` to be possible."""
    return least * (1 - SHARE_SLACK) - SLACK


@dataclass
class Shard:
    """An inverted index; impacts are a term's scores without its idf. Postings lie by block, then term and document."""

    ids: np.ndarray
    terms: pa.Array
    edges: np.ndarray  # where each block's documents begin, and the end
    posting: np.ndarray  # a document's place in its block and the impact, as one number
    run_first: np.ndarray  # of each term's runs, a run being its postings in one block
    run_at: np.ndarray  # where each run's postings begin
    run_size: np.ndarray
    run_block: np.ndarray
    run_max: np.ndarray
    row: np.ndarray  # of each term in the next four, or -1
    row_max: np.ndarray  # block maxima by row and block
    row_run: np.ndarray  # runs by row and block
    row_found: np.ndarray  # documents by row and block
    table: np.ndarray  # impacts by row and document, for the most frequent terms
    doc_first: np.ndarray  # of each document's terms
    doc_term: np.ndarray
    doc_impact: np.ndarray
    weight: np.ndarray  # of each term in the query at hand, else 0
    kind_of: np.ndarray  # the place of each term among those that clusters go by, or -1
    centre: np.ndarray  # of each cluster, by these terms

    @classmethod
    def of(cls, ids: np.ndarray, texts: pa.Array, mean_length: float) -> "Shard":
        """Indexes texts."""
        term, doc, tf, terms, length = _postings(texts)
        n, v = max(len(ids), 1), len(terms)
        if not len(ids):
            length = np.zeros(1, np.int64)
        found = np.bincount(term, minlength=v)
        most = np.argsort(-found, kind="stable")[: TABLE_CELLS // n]
        common = np.sort(most[found[most] * TABLE_SHARE >= n])
        frequent = np.sort(most[:KIND_TERMS][found[most[:KIND_TERMS]] * KIND_SHARE >= n])
        kind, centre = _kinds(term, doc, frequent, n)
        kind_of = np.full(v, -1)
        kind_of[frequent] = np.arange(len(frequent))
        by_kind = np.lexsort((length, kind))
        rank = np.empty(n, np.int64)
        rank[by_kind] = np.arange(n)
        edges = _edges(np.bincount(kind))
        blocks = len(edges) - 1
        doc, length = rank[doc], length[by_kind]
        order = np.argsort(term * n + doc, kind="stable")
        doc, tf = doc[order], tf[order]
        del order
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean_length))
        block = np.repeat(np.arange(blocks), np.diff(edges))[doc]
        run_at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
        run_max = np.maximum.reduceat(impact, run_at) if v else impact
        run_term, run_block = term[run_at], block[run_at]
        run_first = np.searchsorted(run_term, np.arange(v + 1))
        run_size = np.diff(np.append(run_at, len(doc)))
        by_block = np.argsort(block, kind="stable")
        posting = np.empty(len(doc), POSTING)
        posting["doc"], posting["impact"] = (doc - edges[block])[by_block], impact[by_block]
        first = np.argsort(run_block, kind="stable")
        run_at[first] = np.cumsum(run_size[first]) - run_size[first]
        row = np.full(v, -1)
        row[common] = np.arange(len(common))
        row_max, row_run, row_found = (np.zeros((len(common), blocks), kind) for kind in (np.float32, np.int32, np.int32))
        inside = np.flatnonzero(row[run_term] >= 0)
        at = row[run_term[inside]], run_block[inside]
        row_max[at], row_run[at], row_found[at] = run_max[inside], inside, run_size[inside]
        table = np.zeros((len(common), n), np.float32)
        at = np.flatnonzero(row[term] >= 0)
        table[row[term[at]], doc[at]] = impact[at]
        by_doc = np.argsort(doc, kind="stable")
        doc_first = np.searchsorted(doc[by_doc], np.arange(n + 1))
        return cls(ids[by_kind], terms, edges, posting.view(np.int64), run_first, run_at, run_size.astype(np.int32), run_block.astype(np.int16 if blocks < 1 << 15 else np.int32), run_max.astype(np.float32), row, row_max, row_run, row_found, table, doc_first, term[by_doc].astype(np.int32), impact[by_doc], np.zeros(v), kind_of, centre)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[list[tuple[float, int]]]:
        """(score, id) of the best k documents for each query (terms, weights, least score); terms are codes of this shard."""
        out: list[list[tuple[float, int]]] = [[] for _ in queries]
        order = self._alike(queries)
        for at in range(0, len(queries), TILE_ROWS):
            some = order[at : at + TILE_ROWS]
            for q, found in zip(some, Tile(self, [queries[q] for q in some], k).searched()):
                out[q] = found
        return out

    def _alike(self, queries: list[tuple[np.ndarray, np.ndarray, float]]) -> list[int]:
        """The queries' places by cluster, so that a tile's queries share their common terms and their blocks."""
        q = np.repeat(np.arange(len(queries)), [len(t) for t, _, _ in queries])
        place = self.kind_of[np.concatenate([t for t, _, _ in queries])] if queries else q
        has = np.zeros((len(queries), self.centre.shape[1]), np.float32)
        has[q[place >= 0], place[place >= 0]] = 1
        return np.argsort((has @ self.centre.T).argmax(1), kind="stable").tolist()


class Tile:
    """Queries (terms, weights, least score) that are searched in a shard together."""

    def __init__(self, shard: Shard, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int):
        self.shard, self.queries, self.k = shard, queries, k
        self.least = np.array([least for _, _, least in queries])
        self.best: list[list[tuple[float, int]]] = [[] for _ in queries]
        terms, weights = (np.concatenate([x[i] for x in queries]) for i in (0, 1))
        q = np.repeat(np.arange(len(queries)), [len(t) for t, _, _ in queries])
        row = shard.row[terms]
        tabled, rare = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
        self.common = np.zeros((len(queries), len(shard.table)), np.float32)
        self.query, self.row = q[tabled], row[tabled]
        self.common[self.query, self.row] = weights[tabled]
        first = shard.run_first[terms[rare]]
        count = shard.run_first[terms[rare] + 1] - first
        run, of = spread(count, first), np.repeat(rare, count)
        block = shard.run_block[run]
        by_block = np.argsort(block, kind="stable")  # each block's by query, in the order of the query's terms
        self.run, of, block = run[by_block], of[by_block], block[by_block]
        self.run_query, self.run_weight = q[of], weights[of]
        self.run_bound = shard.run_max[self.run] * self.run_weight
        blocks = len(shard.edges) - 1
        self.run_edges = np.searchsorted(block, np.arange(blocks + 1))
        self.bounds = self.common @ shard.row_max + np.bincount(self.run_query * blocks + block, self.run_bound, len(queries) * blocks).reshape(-1, blocks)

    def searched(self) -> list[list[tuple[float, int]]]:
        """(score, id) of each query's best documents; the blocks that promise most come first."""
        for b in np.argsort(-self.bounds.sum(0), kind="stable").tolist():
            live = np.flatnonzero((self.bounds[:, b] > 0) & (self.bounds[:, b] >= _cut(self.least)))
            if len(live):
                self._block(b, live)
        return [[(-s, i) for s, i in found] for found in self.best]

    def _block(self, b: int, live: np.ndarray) -> None:
        """Scores a block's documents for the queries whose bound there reaches their threshold."""
        s, n = self.shard, len(live)
        low, size = s.edges[b], s.edges[b + 1] - s.edges[b]
        # terms that many of these queries and documents have: by a matrix product
        place = np.full(len(self.queries), -1)
        place[live] = np.arange(n)
        q, row = place[self.query], self.row
        if n < len(self.queries):
            q, row = q[q >= 0], row[q >= 0]
        work = np.bincount(row, minlength=len(s.table)) * s.row_found[:, b]
        dense = np.flatnonzero(work * DENSE >= n * size) if size else work
        score = self.common[np.ix_(live, dense)] @ s.table[dense, low : low + size]
        # the other terms of the table, and from the pivot on the rarer ones: by their postings
        work *= work * DENSE < n * size
        thin = np.flatnonzero(work[row])
        q, row = q[thin], row[thin]
        run, weight = s.row_run[row, b], self.common[live[q], row]
        part = slice(self.run_edges[b], self.run_edges[b + 1])
        rare = place[self.run_query[part]]
        met = np.flatnonzero(rare >= 0)
        rare, bound = rare[met], self.run_bound[part][met]
        cut = _cut(self.least[live])
        cumulated = np.append(0.0, np.cumsum(bound))
        shut = cumulated[1:] - cumulated[np.searchsorted(rare, np.arange(n))][rare] <= (PIVOT * cut - score.max(1, initial=0))[rare]
        rest = np.bincount(rare[shut], bound[shut], n)
        met = met[~shut]
        run, q = np.concatenate([run, self.run[part][met]]), np.concatenate([q, rare[~shut]])
        weight = np.concatenate([weight, self.run_weight[part][met]]).astype(np.float32)
        first, count = s.run_at[run], s.run_size[run]
        opened = np.cumsum(count)
        flat, base, at = score.reshape(-1), q * size, 0
        while at < len(run):
            end = max(at + 1, int(np.searchsorted(opened, opened[at] - count[at] + POSTINGS, "right")))
            some = slice(at, end)
            posting = s.posting.take(spread(count[some], first[some])).view(POSTING)
            to = np.repeat(base[some], count[some])
            to += posting["doc"]
            given = np.repeat(weight[some], count[some])
            given *= posting["impact"]
            np.add.at(flat, to, given)
            at = end
        # a document's score so far and the maxima of the unopened terms bound its score
        hit = score >= np.maximum(cut - rest, TINY).astype(np.float32)[:, None]
        for i in np.flatnonzero(hit.any(1)).tolist():
            doc = np.flatnonzero(hit[i])
            self._completed(int(live[i]), low + doc, score[i, doc].astype(np.float64), float(rest[i]))

    def _completed(self, q: int, doc: np.ndarray, score: np.ndarray, rest: float) -> None:
        """Scores documents from their own lists of terms, the most promising ones first."""
        s, k = self.shard, self.k
        terms, weights, _ = self.queries[q]
        if len(doc) > k:
            kept = score + rest >= _cut(float(np.partition(score, len(score) - k)[len(score) - k]))
            doc, score = doc[kept], score[kept]
        order = np.argsort(-score, kind="stable")
        doc, upper = doc[order], score[order] + rest
        s.weight[terms] = weights
        done, step = 0, k
        while done < len(doc) and upper[done] >= _cut(self.least[q]):
            some = doc[done : done + step]
            done, step = done + step, 2 * step
            count = s.doc_first[some + 1] - s.doc_first[some]
            entry = spread(count, s.doc_first[some])
            exact = np.round(np.add.reduceat(s.weight[s.doc_term[entry]] * s.doc_impact[entry], np.cumsum(count) - count), 6)
            good = exact >= self.least[q] - SLACK
            self.best[q] = sorted(self.best[q] + list(zip((-exact[good]).tolist(), s.ids[some[good]].tolist())))[:k]
            if len(self.best[q]) == k:
                self.least[q] = max(self.least[q], -self.best[q][-1][0])
        s.weight[terms] = 0


class Vocabulary:
    """The distinct terms of all queries and their weights by code, which a task holds once, and each term's place in the shard at hand."""

    def __init__(self, folder: str, starts: list[int]):
        terms, codes, weights = [pa.array([], pa.binary())], [np.zeros(0, np.int64)], [np.zeros(0)]
        for uri in folder_files(folder):
            system, at = opened(uri)
            with system.open_input_file(at) as f:
                for batch in pq.ParquetFile(f).iter_batches(1 << 16):
                    terms.append(batch.column("term"))
                    codes.append(coded(batch.column("at").to_numpy(), starts))
                    weights.append(batch.column("weight").to_numpy())
        self.terms, self.codes = pa.chunked_array(terms), np.concatenate(codes)
        self.weights = np.zeros(starts[-1])
        self.weights[self.codes] = np.concatenate(weights)

    def places(self, shard: Shard) -> np.ndarray:
        """The shard's code of each term, or -1."""
        out = np.full(len(self.weights), -1, np.int32)
        if len(shard.terms):
            out[self.codes] = pc.index_in(self.terms, value_set=shard.terms).fill_null(-1).to_numpy()
        return out


def coded(at, starts: list[int]):
    """Numbers from 0 on without gaps, for those of Spark, in which the upper bits are the partition's."""
    return np.asarray(starts)[at >> 33] + (at & (1 << 33) - 1)


def searched(shard: Shard, places: np.ndarray, vocabulary: Vocabulary, queries: pa.Table, k: int, least: np.ndarray):
    """For each query that shares a term with the shard its place and the shard's results."""
    codes = queries.column("codes").combine_chunks()
    off = codes.offsets.to_numpy().astype(np.int64) - codes.offsets[0].as_py()
    codes = codes.flatten().to_numpy()
    here = places[codes]
    kept = here >= 0
    off = np.append(0, np.cumsum(kept))[off]
    terms, weights = here[kept], vocabulary.weights[codes[kept]]
    met = np.flatnonzero(np.diff(off)).tolist()
    return zip(met, shard.search([(terms[off[i] : off[i + 1]], weights[off[i] : off[i + 1]], float(least[i])) for i in met], k))


def _shards(batches):
    """Ids and texts of a task's shards, from its rows (doc_id, text)."""
    ids, texts, size, rows = [], [], 0, 0

    def made():
        nonlocal ids, texts, size, rows
        out = np.concatenate(ids), pa.concat_arrays(texts)
        ids, texts, size, rows = [], [], 0, 0
        return out

    for batch in batches:
        for part, text in chunks(batch, "text"):
            known = part.column(0).is_valid()
            if rows and (size + text.nbytes > SHARD_BYTES or rows + len(text) > SHARD_DOCS):
                yield made()
            ids.append(part.column(0).filter(known).to_numpy(zero_copy_only=False))
            texts.append(text.filter(known))
            size, rows = size + text.nbytes, rows + len(text)
    if rows:
        yield made()


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, n, words): in how many texts each term is; the row with a null term has the number of texts and words."""

    def counted(texts: pa.Array):
        text, code, terms = terms_of(texts)
        pair = pc.unique(pa.array(code.astype(np.int64) * max(len(texts), 1) + text)).to_numpy() // max(len(texts), 1)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([len(texts)]), pa.array([len(code)])], ["term", "n", "words"])
        yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(pair, minlength=len(terms))), pa.array(np.zeros(len(terms), np.int64))], ["term", "n", "words"])

    def run(batches):
        lean()
        held, size = [], 0
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                held.append(texts)
                size += texts.nbytes
                if size >= COUNT_BYTES:
                    yield from counted(pa.concat_arrays(held))
                    held, size = [], 0
        if held:
            yield from counted(pa.concat_arrays(held))

    return docs.mapInArrow(run, "term binary, n bigint, words bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times, words): the distinct terms of each query text, how often it has each, and its number of words."""

    def run(batches):
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                text, code, terms = terms_of(texts)
                pair, times = np.unique(text * max(len(terms), 1) + code, return_counts=True)
                text, code = pair // max(len(terms), 1), pair % max(len(terms), 1)
                words = np.bincount(text, times, len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), terms.take(pa.array(code)), pa.array(times.astype(np.int64)), pa.array(words[text])], ["query_id", "term", "times", "words"])

    return queries.mapInArrow(run, "query_id bigint, term binary, times bigint, words bigint")


def copied(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id) of those queries whose text at least k documents have, so that their k-th best score is no less than what the text scores for itself."""
    text = F.sha2("text", 256).alias("text")
    often = docs.where("doc_id is not null").select(text).groupBy("text").count().where(F.col("count") >= k)
    once = queries.select("query_id", text).groupBy("query_id").agg(F.min("text").alias("text"), F.count("*").alias("rows")).where("rows = 1")
    return once.join(often, "text", "left_semi").select("query_id")


RESULT = "block int, query_id array<bigint>, doc_id array<bigint>, score array<double>"


def _packed(block: int, rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    q, d, s = zip(*rows) if rows else ((), (), ())
    cols = [pa.array([block], pa.int32()), pa.array([list(q)], pa.list_(pa.int64())), pa.array([list(d)], pa.list_(pa.int64())), pa.array([list(s)], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cols, ["block", "query_id", "doc_id", "score"])


def _blocks(folder: str):
    """Queries of the folder's files, a bounded number at a time, numbered alike in every task."""
    block = 0
    for uri in folder_files(folder):
        system, at = opened(uri)
        with system.open_input_file(at) as f:
            for batch in pq.ParquetFile(f).iter_batches(QUERY_ROWS):
                yield block, pa.Table.from_batches([batch])
                block += 1


def _ranked(docs: DataFrame, folder: str, terms: str, starts: list[int], k: int, mean_length: float) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best of docs for the queries of the folder (query_id, codes, least), whose terms are in another (term, weight, at)."""

    def search(batches):
        lean()
        vocabulary = None
        known: dict[int, np.ndarray] = {}  # thresholds by block of queries, as the task's shards have raised them
        for keys, texts in _shards(batches):
            shard = Shard.of(keys, texts, mean_length)
            del keys, texts
            vocabulary = vocabulary or Vocabulary(terms, starts)
            places = vocabulary.places(shard)
            for block, some in _blocks(folder):
                ids = some.column("query_id").to_pylist()
                least = known.setdefault(block, np.nan_to_num(some.column("least").to_numpy().astype(float)))
                rows = []
                for i, found in searched(shard, places, vocabulary, some, k, least):
                    rows += [(ids[i], d, s) for s, d in found]
                    if len(found) == k:
                        least[i] = max(least[i], found[-1][0])
                if rows:
                    yield _packed(block, rows)
            del shard  # before the next one is made

    def merge(batches):
        now, best = None, {}

        def done():
            rows = [(q, r, d, -s) for q, found in sorted(best.items()) for r, (s, d) in enumerate(found, 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "doc_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now and best:
                    yield done()
                    best = {}
                now = row["block"]
                got: dict[int, list] = {}
                for q, d, s in zip(row["query_id"], row["doc_id"], row["score"]):
                    got.setdefault(q, []).append((-s, d))
                for q, found in got.items():
                    best[q] = sorted(best.get(q, []) + found)[:k]
        if best:
            yield done()

    packed = docs.mapInArrow(search, RESULT)
    return packed.repartition(width(docs.sparkSession), "block").sortWithinPartitions("block").mapInArrow(merge, "query_id bigint, rank int, doc_id bigint, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents (doc_id, text) for each query (query_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    queries = settled(queries.select(F.col("query_id").cast("long"), F.col("text").cast("string").alias("text")).where("query_id is not null"), "query-texts")
    wanted = settled(query_terms(queries), "query-terms")
    known = settled(term_statistics(docs.where("doc_id is not null")), "term-statistics")
    total = known.where("term is null").first()
    n, mean_length = (total.n, max(total.words / total.n, 1e-9)) if total else (0, 1.0)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    idf = F.log(1 + (n - F.col("n") + 0.5) / (F.col("n") + 0.5))
    # the queries' terms, numbered as they are written
    asked = known.join(wanted.select("term").distinct(), "term").select("term", idf.alias("weight"), F.monotonically_increasing_id().alias("at"))
    terms = shared_folder(spark, "search-terms")
    asked.write.parquet(terms)
    asked = spark.read.schema(asked.schema).parquet(terms)
    sizes = {r.part: r.n for r in asked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    starts = np.cumsum([0] + [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]).tolist()
    code = F.element_at(F.array(*map(F.lit, starts)), (F.shiftright("at", 33) + 1).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)
    # one row a query, whose size is that of its text; the lightest terms come first
    one = F.array_sort(F.collect_set(F.struct("weight", code.cast("int").alias("code"))))
    own = F.sum(F.col("weight") * F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("words") / mean_length)))
    plain = wanted.join(asked, "term").groupBy("query_id").agg(one.alias("x"), own.alias("own")).select("query_id", F.col("x.code").alias("codes"), "own")
    held = copied(docs, queries, k).withColumn("held", F.lit(True))
    least = F.when(F.col("held"), F.greatest(F.lit(0.0), F.col("own") - SLACK)).otherwise(0.0)
    plain = settled(plain.join(held, "query_id", "left").select("query_id", "codes", least.alias("least")), "search-queries")
    # queries with the same terms are searched once
    alike = plain.select("query_id", F.min("query_id").over(Window.partitionBy("codes")).alias("first"))
    at = shared_folder(spark, "search-queries")
    plain.groupBy("codes").agg(F.min("query_id").alias("query_id"), F.max("least").alias("least")).write.parquet(at)

    # the first round: every SEED_SHARE-th document
    seed = docs.where(f"doc_id is not null and pmod(xxhash64(doc_id), {SEED_SHARE}) = 0")
    seeds = settled(seed.repartition(-(-4 * n // SEED_SHARE // SHARD_DOCS) or 1), "search-seed")
    least = _ranked(seeds, at, terms, starts, k, mean_length).where(f"rank = {k}").select("query_id", F.col("score").alias("least"))
    raised = shared_folder(spark, "search-queries")
    known = spark.read.parquet(at).withColumnRenamed("least", "own").join(least, "query_id", "left")
    known.select("query_id", "codes", F.greatest("own", F.coalesce("least", F.lit(0.0))).alias("least")).write.parquet(raised)
    found = _ranked(docs, raised, terms, starts, k, mean_length).withColumnRenamed("query_id", "first")
    return found.join(alike, "first").select("query_id", "rank", "doc_id", "score")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the whole text of every document whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents")
    return top_k(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"))

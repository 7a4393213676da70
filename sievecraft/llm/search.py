"""Exact top-k BM25 search over an inverted index with block-max WAND.

Index: every task turns its documents into segments of about ``SEGMENT`` documents or ``SEGMENT_WORDS`` words: sorted
term hashes, postings (local document, frequency) and document lengths. The segments go to the checkpoint folder.

Statistics (documents, total length, document frequency of each query term) are summed over all segments, so scores
are those of one global index. Once they are known, each segment gets its block maxima and is written again: the
documents of a segment come in blocks of ``WIDTH``, a *cell* is what one term has in one block, and with each cell
stand its first posting and the largest contribution in it.

Search: queries are taken in blocks of bounded size (``BLOCK_TERMS`` query terms), each of which is broadcast and run
over all segments. In a segment the queries go in batches of those with the same frequent terms. Blocks are of variable
size: of rare terms, each posting is a block of its own, whose bound is exact; terms in at least ``SHARE`` of the
documents have their cells. Together they give each block of documents an upper bound for each query, and the pivots are
the blocks whose bound reaches the k-th best score so far of a query of the batch (which a task carries from segment to
segment); the others are skipped without reading a weight of a frequent term. At the pivots the frequent terms of the
batch are added by a product of matrices in 32 bits, whose error is bounded; documents that may reach the k-th best
score by it are scored exactly from their own terms. Results of the tasks are merged exactly.

Scores are compared to nine decimals, ties go to the smaller doc_id. Defined results: null texts hold no term; a query
without terms, or whose terms are in no document, has no rows; every document that shares a term counts as found,
however small its score; rows repeated in full are rows of their own; rows with a null id come last among ties and are
no queries; empty tables give an empty result; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.llm.batches import short_batches
from sievecraft.session import checkpointed

SEGMENT, SEGMENT_WORDS, WIDTH, BLOCK_TERMS = 32_768, 4_000_000, 64, 2_000_000
#: A term in at least ``SHARE`` of a segment's documents is a frequent one, the ``FREQUENT`` most frequent at most, and as many as fit ``CELLS`` weights.
SHARE, FREQUENT, CELLS = 0.05, 2_048, 16_000_000
#: Queries whose bounds are taken at once, weights of queries x documents of a batch, and postings that are added up at once.
QUERIES, TOGETHER, NEAR = 4_096, 2_000_000, 100_000
K1, B = 1.2, 0.75
NO_ID = (1 << 63) - 1
_TERMS = re.compile(r"\w+").findall


class Memo(dict):
    """Hashes of the words seen; emptied when it has grown to ``most`` words."""

    most = 100_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def terms_of(text: str | None, memo: Memo) -> np.ndarray:
    words = _TERMS((text or "").lower())
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _store(*arrays: np.ndarray) -> bytes:
    pack = zstandard.ZstdCompressor(level=1).compress
    parts = [pack(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()) if len(a) else b"" for a in arrays]
    return np.array([x for a, p in zip(arrays, parts) for x in (len(a), len(p))], "<i8").tobytes() + b"".join(parts)


def _load(b: bytes, *types: type) -> list[np.ndarray]:
    head, at, out = np.frombuffer(b, "<i8", 2 * len(types)), 16 * len(types), []
    for k, t in enumerate(types):
        n, size = int(head[2 * k]), int(head[2 * k + 1])
        raw = zstandard.ZstdDecompressor().decompress(b[at : at + size]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(t).itemsize, n).T).view(t).reshape(-1) if n else np.zeros(0, t))
        at += size
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo()
    ids: list[int] = []
    lengths: list[int] = []
    terms: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        n = np.array(lengths, np.int32)
        flat = np.concatenate(terms) if terms else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.argsort(flat, kind="stable")
        flat, doc = flat[order], doc[order]
        new = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])]) if len(flat) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[new, len(flat)]).astype(np.int32)
        flat, doc = flat[new], doc[new]
        # Alike documents side by side: by the term that is most frequent in each, then by length.
        lead, most = np.zeros(len(n), np.uint64), int(tf.max()) + 1 if len(tf) else 1
        best = np.argsort(doc * np.int64(most) - tf, kind="stable")
        best = best[np.r_[True, doc[best][1:] != doc[best][:-1]]] if len(doc) else best
        lead[doc[best]] = flat[best]
        row = np.lexsort((n, lead))
        rank = np.empty(len(n), np.int64)
        rank[row] = np.arange(len(n))
        doc = rank[doc]
        order = np.argsort(np.cumsum(np.r_[False, flat[1:] != flat[:-1]]) * np.int64(len(n)) + doc) if len(flat) else order
        flat, doc, tf = flat[order], doc[order].astype(np.int32), tf[order]
        ids_, n = np.array(ids, np.int64)[row], n[row]
        cut = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        body = _store(ids_, n, flat[cut], np.diff(np.r_[cut, len(flat)]).astype(np.int32), doc, tf)
        row = [pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([body], pa.binary())]
        ids.clear(), lengths.clear(), terms.clear()
        return pa.RecordBatch.from_arrays(row, names=["docs", "words", "body"])

    size = 0
    for b in batches:
        for d, t in zip(b.column(0).to_pylist(), b.column(1)):
            h = terms_of(t.as_py(), memo)
            ids.append(d)
            lengths.append(len(h))
            terms.append(h)
            size += len(h)
            if len(ids) >= SEGMENT or size >= SEGMENT_WORDS:
                yield flush()
                size = 0
    if ids:
        yield flush()


_TYPES = (np.int64, np.int32, np.uint64, np.int32, np.int32, np.int32)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, words, body: the segments of the inverted index, written to the checkpoint folder."""
    picked = short_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    return checkpointed(picked.mapInArrow(_segments, "docs long, words long, body binary"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column(0):
            _, _, terms, df, _, _ = _load(body.as_py(), *_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo()
    for b in batches:
        for q, t in zip(b.column(0).to_pylist(), b.column(1)):
            h = np.unique(terms_of(t.as_py(), memo)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), q, np.int64)), pa.array(h)], names=["query_id", "term"])


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + count[i] - 1, one run after another."""
    out = np.repeat(start - (np.cumsum(count) - count), count)
    out += np.arange(len(out))
    return out


def _weights(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _with_maxima(average: float):
    """Segments with their cells: block, first posting and, rounded up to 32 bits, the largest contribution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body in b.column(0):
                ids, n, terms, df, doc, tf = _load(body.as_py(), *_TYPES)
                term_at, block = np.repeat(np.arange(len(terms), dtype=np.int32), df), (doc // WIDTH).astype(np.int32)
                first = np.flatnonzero(np.r_[True, (term_at[1:] != term_at[:-1]) | (block[1:] != block[:-1])]).astype(np.int32) if len(doc) else np.zeros(0, np.int32)
                top = np.maximum.reduceat(_weights(tf, n[doc], average), first) if len(doc) else np.zeros(0)
                cells = np.bincount(term_at[first], minlength=len(terms)).astype(np.int32)
                out = _store(ids, n, terms, doc, tf, cells, block[first], np.diff(np.r_[first, len(doc)]).astype(np.int32), np.nextafter(top.astype(np.float32), np.float32(np.inf)))
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["body"])

    return run


_CELL_TYPES = (np.int64, np.int32, np.uint64, np.int32, np.int32, np.int32, np.int32, np.int32, np.float32)


class Segment:
    """One segment in memory: lists of its terms, weights of the frequent ones and their block maxima as matrices, terms of each document."""

    def __init__(self, body: bytes, average: float):
        self.ids, n, self.terms, doc, tf, cells, block, count, top = _load(body, *_CELL_TYPES)
        weight = _weights(tf, n[doc], average)
        self.doc, size = doc, len(self.ids)
        self.weight = weight.astype(np.float32)
        self.blocks = -(-size // WIDTH)
        start = np.r_[0, np.cumsum(cells, dtype=np.int64)]
        df = np.add.reduceat(count, start[:-1], dtype=np.int64) if len(cells) else np.zeros(0, np.int64)
        self.post = np.r_[0, np.cumsum(df)]
        most = min(FREQUENT, CELLS // max(1, self.blocks * WIDTH))
        often = np.argsort(-df, kind="stable")[:most]
        often = often[df[often] >= SHARE * size]
        self.row = np.full(len(df), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.often = np.zeros((self.blocks * WIDTH, len(often)), np.float32)
        posts, cell = _runs(self.post[often], df[often]), _runs(start[often], start[often + 1] - start[often])
        self.often[self.doc[posts], np.repeat(np.arange(len(often)), df[often])] = self.weight[posts]
        self.often = self.often.reshape(self.blocks, WIDTH, len(often))
        self.top = np.zeros((self.blocks, len(often)), np.float32)
        self.top[block[cell], np.repeat(np.arange(len(often)), start[often + 1] - start[often])] = top[cell]
        order = np.argsort(doc.astype(np.uint16) if size <= 1 << 16 else doc, kind="stable")
        self.own_term, self.own_weight = np.repeat(np.arange(len(df), dtype=np.int32), df)[order], weight[order]
        self.own = np.r_[0, np.cumsum(np.bincount(doc, minlength=size))]
        #: A sum in 32 bits is within this share of the true one, since nothing in it is negative.
        self.slack = (len(often) + 16) * 2.0**-23

    def _rare(self, starts: np.ndarray, at: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """What these terms, starts[i] .. starts[i + 1] of query i, give each document; few queries at once, so that their lists stay near."""
        size, n = self.blocks * WIDTH, len(starts) - 1
        out, read = np.zeros((n, size)), np.r_[0, np.cumsum(self.post[at + 1] - self.post[at])][starts]
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(read, read[i] + NEAR, side="right")) - 1)
            mine = at[starts[i] : starts[j]]
            count = self.post[mine + 1] - self.post[mine]
            posts = _runs(self.post[mine], count)
            part = self.weight.take(posts) * np.repeat(idf[starts[i] : starts[j]], count)
            where = self.doc.take(posts) + np.repeat(np.arange(j - i) * size, read[i + 1 : j + 1] - read[i:j])
            out[i:j] = np.bincount(where, part, (j - i) * size).reshape(j - i, size)
            i = j
        return out

    def _scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores; weights: of each term of the segment in the query, 0 for those that it lacks."""
        count = self.own[docs + 1] - self.own[docs]
        own = _runs(self.own[docs], count)
        return np.bincount(np.repeat(np.arange(len(docs)), count), weights.take(self.own_term.take(own)) * self.own_weight.take(own), len(docs))

    def search_all(self, starts: np.ndarray, which: np.ndarray, terms: np.ndarray, idf: np.ndarray, k: int, floors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """query, ids, scores: what of this segment may be among the k best of a query, given that k others score at least its floor.

        Query i has the terms which[starts[i]] .. which[starts[i + 1] - 1], as places in ``terms`` and ``idf``.
        """
        if not len(self.terms):
            return
        place = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        place[self.terms[place] != terms] = -1
        weights = np.zeros(len(self.terms))
        for first in range(0, len(starts) - 1, QUERIES):
            last = min(first + QUERIES, len(starts) - 1)
            mine = which[starts[first] : starts[last]]
            query = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1]))
            at, w = place[mine], idf[mine]
            query, at, w = query[at >= 0], at[at >= 0], w[at >= 0]
            row = self.row[at]
            asked = np.zeros((last - first, self.top.shape[1]), np.float32)
            asked[query[row >= 0], row[row >= 0]] = w[row >= 0]
            bound = asked @ self.top.T
            # Queries with the same most frequent term stand together, then those with the same best block, so that a batch needs few blocks.
            order = np.lexsort((bound.argmax(axis=1), (asked > 0).argmax(axis=1))) if asked.shape[1] else np.arange(last - first)
            count = np.bincount(query, minlength=len(order))
            by = _runs((np.cumsum(count) - count)[order], count[order])
            at, w, row = at[by], w[by], row[by]
            ends = np.r_[0, np.cumsum(count[order])]
            few = row < 0
            few_ends, few_at, few_w = np.r_[0, np.cumsum(few)][ends], at[few], w[few]
            step = max(1, TOGETHER // (self.blocks * WIDTH))
            for i in range(0, len(order), step):
                j = min(i + step, len(order))
                batch = order[i:j]
                floor = floors[first + batch]
                score = self._rare(few_ends[i : j + 1] - few_ends[i], few_at[few_ends[i] : few_ends[j]], few_w[few_ends[i] : few_ends[j]]).reshape(j - i, self.blocks, WIDTH)
                best = (score.max(axis=2) + bound[batch]) * (1 + self.slack)
                # The pivots: blocks whose bound reaches the k-th best score of a query of the batch. All others are skipped.
                pivots = np.flatnonzero(((best > 0) & (best >= floor[:, None] - 1e-9)).any(axis=0))
                if not len(pivots):
                    continue
                often, mine = self.often[pivots].reshape(len(pivots) * WIDTH, -1), asked[batch]
                used = np.flatnonzero(mine.any(axis=0))
                if 2 * len(used) < often.shape[1]:
                    often, mine = often.take(used, axis=1), mine.take(used, axis=1)
                found = mine @ often.T
                found += score[:, pivots].reshape(j - i, -1)
                least, new = floor - 1e-9, np.flatnonzero(floor <= 0)
                if len(new) and found.shape[1] > k:
                    least[new] = np.partition(found[new], found.shape[1] - k, axis=1)[:, found.shape[1] - k] - 1e-9
                least = np.nextafter((least * (1 - 2 * self.slack)).astype(np.float32), np.float32(-np.inf))
                who, doc = np.nonzero(found >= np.maximum(least, np.nextafter(np.float32(0), np.float32(1)))[:, None])
                doc = pivots[doc // WIDTH] * WIDTH + doc % WIDTH
                cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1], True]) if len(who) else ()
                for a, b in zip(cut[:-1], cut[1:]):
                    q, docs = who[a], doc[a:b]
                    terms_ = slice(ends[i + q], ends[i + q + 1])
                    weights[at[terms_]] = w[terms_]
                    raw = self._scores(docs, weights)
                    weights[at[terms_]] = 0
                    got = np.round(raw, 9)
                    keep = (raw > 0) & (got >= floor[q])
                    ids, got = self.ids[docs[keep]], got[keep]
                    keep = np.lexsort((ids, -got))[:k]
                    yield int(first + batch[q]), ids[keep], got[keep]

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of one query."""
        for _, ids, scores in self.search_all(np.array([0, len(terms)]), np.arange(len(terms)), terms, idf, k, np.array([floor])):
            return ids, scores
        return self.ids[:0], np.zeros(0)


def _searched(queries, average: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, starts, which, terms, idf = queries.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        floors = np.zeros(len(qids))
        for b in batches:
            for body in b.column(0):
                for j, ids, scores in Segment(body.as_py(), average).search_all(starts, which, terms, idf, k, floors):
                    if not len(ids):
                        continue
                    if (old := best.get(j)) is not None:
                        ids, scores = np.concatenate((old[0], ids)), np.concatenate((old[1], scores))
                    keep = np.lexsort((ids, -scores))[:k]
                    best[j] = (ids[keep], scores[keep])
                    if len(keep) == k:
                        floors[j] = scores[keep[-1]]
        if best:
            n = [len(best[j][0]) for j in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[list(best)], n)), pa.array(np.concatenate([x[0] for x in best.values()])), pa.array(np.concatenate([x[1] for x in best.values()]))], names=["query_id", "doc_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """query_id, rank, doc_id, score: for every query the k best documents of the index; the score as rounded to compare."""
    spark = index.sparkSession
    n, words = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(text_col).alias("text")).mapInArrow(_query_terms, "query_id long, term long")
    df = index.select("body").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weighed = checkpointed(asked.join(df, "term").select("query_id", "term", idf.alias("idf")).distinct())
    blocks, average = max(1, -(-weighed.count() // block_terms)), words / max(n, 1)
    celled = checkpointed(index.select("body").mapInArrow(_with_maxima(average), "body binary"))
    found = []
    for block in range(blocks):
        rows = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        q, t, w = rows["query_id"].to_numpy(), rows["term"].to_numpy().view(np.uint64), rows["idf"].to_numpy()
        order = np.lexsort((t, q))
        q, t, w = q[order], t[order], w[order]
        cut = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        terms, first, which = np.unique(t, return_index=True, return_inverse=True)
        shared = spark.sparkContext.broadcast((q[cut], np.r_[cut, len(q)], which.astype(np.int32), terms, w[first]))
        part = celled.mapInArrow(_searched(shared, average, k), "query_id long, doc_id long, score double")
        found.append(checkpointed(part) if blocks > 1 else part)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")

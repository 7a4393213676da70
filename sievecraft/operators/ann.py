"""Nearest neighbours of vectors by an inverted file: cells around centroids, several cells probed by each query.

Centroids are fitted on a bounded sample; every vector is indexed under its nearest one. A cell's vectors are packed
into blocks of about ``BLOCK`` rows, so a cell that holds a third of all vectors is many blocks. A query meets the
vectors of its ``probes`` nearest cells and no others: queries are packed by cell too, and blocks of either side that
share a cell are multiplied as matrices; a block keeps the best k of each of its queries, exact distances throughout.

How many cells are probed is measured, not guessed: for some rows of the table their true neighbours are found by
comparing them with all vectors (a fixed number of rows, so this grows as the table does), and ``probes`` is the least
number that finds the wanted share for half of them; the share found for the other half is reported as the recall.

Defined results: null vectors and those of another length than most are left out; distances are rounded to six digits,
equal ones go to the smaller id; a query is compared with its own row too, if it has one; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.session import arrow_batches, checkpointed

#: Vectors that centroids are fitted on, cells at most, rows of a block, rows whose true neighbours are found, and the share of these to be found.
SAMPLE, MOST_CELLS, BLOCK, KNOWN, WANTED = 20_000, 4_096, 4_096, 400, 0.95
_LAST = np.int64(1 << 62)
_PLACES = 22  # bits of a row's place in its block


def sampled(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """About ``most`` of the ``rows`` rows, chosen by a hash of ``key``; all of them where they are no more."""
    fine = 1 << 52
    return df if rows <= most else df.where(F.pmod(F.xxhash64(key), F.lit(fine)) < int(fine * (most / rows)))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def fit_centroids(x: np.ndarray, cells: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's steps; a cell that loses all its vectors takes the one farthest from its centroid."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(steps):
        near, far = nearest(x, c, 1)
        near = near[:, 0]
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far[:, 0], kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the k nearest centroids of each row, nearest first, and their squared distances."""
    ids, sq = np.zeros((len(x), k), np.int64), np.zeros((len(x), k))
    norm = (c * c).sum(1)
    for at in range(0, len(x), 1024):
        d = norm[None, :] - 2 * x[at : at + 1024] @ c.T
        best = np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(axis=1)[:, None]
        ids[at : at + 1024] = best
        sq[at : at + 1024] = np.take_along_axis(d, best, 1) + (x[at : at + 1024] ** 2).sum(1)[:, None]
    return ids, sq


def packed(rows: DataFrame, keys: list[str], id_col: str, vec_col: str, names: tuple[str, str]) -> DataFrame:
    """One row per group: its ids in order and its vectors, as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        ids = t.column(id_col).to_numpy()
        order = np.argsort(ids, kind="stable")
        v = matrix(t.column(vec_col).combine_chunks())[order].astype(np.float32)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, names[0]: pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), names[1]: pa.array([v.tobytes()], pa.binary())})

    return rows.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} int" for k in keys) + f", {names[0]} binary, {names[1]} binary")


def dealt(rows: DataFrame, by: str, id_col: str, size: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``name``, the piece of its cell that a row is in, and cell, n (pieces); pieces have about ``size`` rows. There are no more cells than MOST_CELLS."""
    n = checkpointed(rows.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias("n")))
    piece = F.pmod(F.xxhash64(id_col), F.col("n")).cast("int").alias(name)
    return rows.join(F.broadcast(n), by).select(*rows.columns, piece), n


def best_of(ids: np.ndarray, v: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """For each query the k smallest keys: distance in millionths, then the place in the block (ids ascend)."""
    sq = np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * q @ v.T, 0)
    key = (np.rint(np.sqrt(sq) * 1e6).astype(np.int64) << _PLACES) | np.arange(len(ids))
    return np.sort(np.partition(key, k - 1, axis=1)[:, :k] if key.shape[1] > k else key, axis=1)


def unpacked(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vs, np.float32).reshape(len(i), -1).astype(np.float64)


@dataclass(frozen=True)
class VectorIndex:
    """cell, piece, ids, vs (packed blocks); cell, n (its pieces); and the centroids."""

    blocks: DataFrame
    pieces: DataFrame
    centroids: np.ndarray
    rows: int


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> VectorIndex | None:
    """Index all rows of ``vectors`` (vec_id, embedding); None for a table without vectors."""
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    sizes = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes or not sizes[0]["dim"]:
        return None
    v, rows = v.where(F.size("embedding") == sizes[0]["dim"]), sizes[0]["count"]
    x = np.array([r[0] for r in sampled(v, "vec_id", sample, rows).orderBy("vec_id").select("embedding").collect()], float)
    if not len(x):  # one id holds all rows, say; a few of them do for centroids
        x = np.array([r[0] for r in v.select("embedding").limit(16).collect()], float)
    centroids = fit_centroids(x, int(min(cells or max(1, round(rows**0.5)), MOST_CELLS, len(x))))
    shared = v.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, _ = nearest(matrix(b.column(1)), shared.value, 1)
            yield pa.RecordBatch.from_arrays([pa.array(near[:, 0].astype(np.int32)), *b.columns], names=["cell", "vec_id", "embedding"])

    placed = checkpointed(v.mapInArrow(assign, "cell int, vec_id long, embedding array<float>"))
    in_pieces, pieces = dealt(placed, "cell", "vec_id", block, "piece")
    return VectorIndex(checkpointed(packed(in_pieces, ["cell", "piece"], "vec_id", "embedding", ("ids", "vs"))), pieces, centroids, rows)


def neighbours_of_some(index: VectorIndex, q: np.ndarray, own: np.ndarray, near: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """(query's number, cell, vec_id) of the k nearest vectors of a few queries, their own rows left out; by comparing with all vectors.

    ``near`` has for each query a distance in millionths and an id that its k-th neighbour does not lie beyond; a task
    hands on what is within these alone, k + 1 rows of a query at most.
    """
    shared = index.blocks.sparkSession.sparkContext.broadcast((q, own, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, (far, last) = shared.value
        best, ids, cells = np.full((len(q), k + 1), _LAST), np.zeros((len(q), k + 1), np.int64), np.zeros((len(q), k + 1), np.int64)
        for b in batches:
            for r in b.to_pylist():
                i, v = unpacked(r["ids"], r["vs"])
                key = best_of(i, v, q, k + 1)
                d, who = np.hstack([best, key >> _PLACES]), np.hstack([ids, i[key & ((1 << _PLACES) - 1)]])
                where = np.hstack([cells, np.full(key.shape, r["cell"])])
                order = np.lexsort((who, d), axis=1)[:, : k + 1]
                best, ids, cells = (np.take_along_axis(m, order, 1) for m in (d, who, where))
        within = (best < far[:, None]) | ((best == far[:, None]) & (ids <= last[:, None]))
        at, j = np.nonzero((best < _LAST) & (ids != own[:, None]) & within)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(cells[at, j].astype(np.int32)), pa.array(ids[at, j]), pa.array(best[at, j])], names=["q", "cell", "vec_id", "d"])

    with arrow_batches(index.blocks.sparkSession, 16):
        found = index.blocks.select("cell", "ids", "vs").mapInArrow(run, "q int, cell int, vec_id long, d long")
        top = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("r") <= k)
        return [(r["q"], r["cell"], r["vec_id"]) for r in top.select("q", "cell", "vec_id").collect()]  # k rows for each of a fixed number of queries


def probes_for(index: VectorIndex, k: int, wanted: float = WANTED, known: int = KNOWN) -> tuple[int, float]:
    """The least number of cells to probe for a share ``wanted`` of true neighbours, and the share found on rows that did not choose it."""
    count = index.blocks.count()
    few = max(1, min(64, int(SAMPLE * count / (2 * max(index.rows, 1)))))  # blocks with about half a sample of rows at most
    some = index.blocks.select("ids", "vs").orderBy(F.xxhash64("cell", "piece"), "cell", "piece").limit(few).collect()
    parts = [unpacked(r["ids"], r["vs"]) for r in some]
    all_own, all_q = np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])
    pick = np.sort(np.random.default_rng(11).permutation(len(all_own))[:known])
    own, q = all_own[pick], all_q[pick]
    order = np.argsort(all_own, kind="stable")
    key = best_of(all_own[order], all_q[order], q, k + 1)  # one of these may be the row itself
    full = key.shape[1] > k
    far = key[:, -1] >> _PLACES if full else np.full(len(q), _LAST)
    last = all_own[order][key[:, -1] & ((1 << _PLACES) - 1)] if full else np.full(len(q), _LAST)
    order, _ = nearest(q, index.centroids, len(index.centroids))
    place = np.argsort(order, axis=1)  # of each cell among a query's cells
    found = np.array(neighbours_of_some(index, q, own, (far, last), k)).reshape(-1, 3)
    ranks, even = place[found[:, 0], found[:, 1]], found[:, 0] % 2 == 0
    chosen, rest = (ranks[even], ranks[~even]) if (~even).any() else (ranks, ranks)
    if not len(chosen):
        return 1, 1.0
    probes = int(np.sort(chosen)[min(len(chosen) - 1, int(np.ceil(wanted * len(chosen))) - 1)]) + 1
    return probes, float((rest < probes).mean())


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int, block: int = 1024) -> DataFrame:
    """qid, vec_id, dist, rank: the k nearest of each query (qid, qvec) among the vectors of its ``probes`` nearest cells."""
    spark = queries.sparkSession
    dim, probes = index.centroids.shape[1], min(probes, len(index.centroids))
    shared = spark.sparkContext.broadcast(index.centroids)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, _ = nearest(matrix(b.column(1)), shared.value, probes)
            row = np.repeat(np.arange(b.num_rows), probes)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), *[c.take(pa.array(row)) for c in b.columns]], names=["cell", "qid", "qvec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (i, v), (qi, q) = unpacked(r["ids"], r["vs"]), unpacked(r["qids"], r["qs"])
                key = best_of(i, v, q, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, key.shape[1])), pa.array(i[(key & ((1 << _PLACES) - 1)).ravel()]), pa.array((key >> _PLACES).ravel())], names=["qid", "vec_id", "d"])

    asked = queries.where("qid is not null and qvec is not null").select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<float>").alias("qvec")).where(F.size("qvec") == dim)
    with arrow_batches(spark, 256):
        routed = checkpointed(asked.mapInArrow(route, "cell int, qid long, qvec array<float>"))
    in_pieces, _ = dealt(routed, "cell", "qid", block, "some")
    held = packed(in_pieces, ["cell", "some"], "qid", "qvec", ("qids", "qs"))
    each = held.join(F.broadcast(index.pieces), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"), "qids", "qs")
    with arrow_batches(spark, 16):
        met = checkpointed(each.join(index.blocks, ["cell", "piece"]).select("ids", "vs", "qids", "qs").mapInArrow(run, "qid long, vec_id long, d long"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("d", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "vec_id", (F.col("d") / 1e6).alias("dist"), "rank")


def all_pairs_top(vectors: DataFrame, k: int, block: int = BLOCK, digits: int = 6) -> DataFrame:
    """qid, other, sim, rank: of every vector (vec_id, embedding) the k others of the largest product, ties to the smaller id.

    All pairs are multiplied, as blocks of the upper triangle; a pair of blocks hands on k rows per vector of either.
    The work grows as the square of the table, which is why it is meant for query sets.
    """
    v = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    n = max(1, -(-v.count() // block))
    held = checkpointed(packed(v.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), ["b"], "vec_id", "embedding", ("ids", "vs")))
    low = held.select(F.col("b").alias("i"), F.explode(F.sequence(F.col("b"), F.lit(n - 1))).alias("j"), F.col("ids").alias("qids"), F.col("vs").alias("qs"))
    high = held.select(F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"), F.col("b").alias("j"), "ids", "vs")

    def best(ids: np.ndarray, of: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = (-np.rint((s + 1e-10) * 10**digits).astype(np.int64) << _PLACES) | np.arange(len(ids))
        key = np.where(of[:, None] == ids[None, :], _LAST, key)
        key = np.partition(key, k - 1, axis=1)[:, :k] if key.shape[1] > k else key
        at, c = np.nonzero(key < _LAST)
        found = key[at, c]
        yield pa.RecordBatch.from_arrays([pa.array(of[at]), pa.array(ids[found & ((1 << _PLACES) - 1)]), pa.array(-(found >> _PLACES))], names=["qid", "other", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                (i, v), (qi, q) = unpacked(r["ids"], r["vs"]), unpacked(r["qids"], r["qs"])
                s = q @ v.T
                yield from best(i, qi, s)
                if r["i"] != r["j"]:
                    yield from best(qi, i, s.T)

    with arrow_batches(vectors.sparkSession, 16):
        met = checkpointed(low.join(high, ["i", "j"]).select("i", "j", "ids", "vs", "qids", "qs").mapInArrow(run, "qid long, other long, s long"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("s"), "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", "other", (F.col("s") / 10**digits).alias("sim"), "rank")


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, wanted: float = WANTED) -> DataFrame:
    """qid, vec_id, dist, rank, probes, cells, recall: of each query (qid, qvec) its k nearest other vectors; recall is the share found, as measured."""
    index = build(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "qid long, vec_id long, dist double, rank int, probes int, cells int, recall double")
    probes, recall = probes_for(index, k, wanted)
    near = search(index, queries, k + 1, probes).where("qid <> vec_id")
    near = near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("rank"))).where(F.col("rank") <= k)
    return near.select("*", F.lit(probes).alias("probes"), F.lit(len(index.centroids)).alias("cells"), F.lit(recall).alias("recall"))

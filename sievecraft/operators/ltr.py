"""Listwise boosted ranking: LambdaMART whose histograms are summed in Spark, one job for each level of a tree.

A row of the training table is a query: the labels and binned features of its documents. A level's job scores each
query by the trees so far, takes the gradients of swapping any two of its documents (the change of nDCG that a swap
makes, times the logistic loss of the pair), places the documents in the nodes of the growing tree and hands on the
sums by node, feature and bin; these are added up by a ``groupBy``, and what reaches the driver is nodes x features x
bins sums, however many queries there are. A task holds ``BATCH`` queries in Python at once. Scores are written every ``KEEP`` trees, so that no job walks through more.

The models of several blocks that are left out grow side by side in the same jobs: a query counts for all models but
that of its own block.

Defined results: documents of a query are in order of their ids, which settles equal scores; queries without two
different labels give no gradient; null features count as 0; of equal gains the first feature, then the lowest bin wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.session import arrow_batches, checkpointed

KEEP, BATCH = 10, 256


def swap_gradients(y: np.ndarray, score: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of a query's documents. Only pairs that touch the first ``depth`` places count (all for None)."""
    n = len(y)
    gain = 2.0**y - 1
    place = np.empty(n, np.int64)
    place[np.argsort(-score, kind="stable")] = np.arange(n)
    discount = 1 / np.log2(place + 2.0)
    ideal = (np.sort(gain)[::-1] / np.log2(np.arange(n) + 2.0)).sum()
    if ideal == 0:
        return np.zeros(n), np.zeros(n)
    better = y[:, None] > y[None, :]
    if depth is not None:
        better &= (place[:, None] < depth) | (place[None, :] < depth)
    swap = np.where(better, np.abs(gain[:, None] - gain[None, :]) * np.abs(discount[:, None] - discount[None, :]) / ideal, 0.0)
    rho = 1 / (1 + np.exp(np.clip(score[:, None] - score[None, :], -50, 50)))
    g, h = swap * rho, swap * rho * (1 - rho)
    return g.sum(axis=0) - g.sum(axis=1), h.sum(axis=0) + h.sum(axis=1)


@dataclass
class Tree:
    """Node k has children 2k + 1 and 2k + 2; rows go right where the bin exceeds ``cut``; a node without a split sends all left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` levels."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            at = 2 * at + 1 + (bins[rows, self.feature[at]] > self.cut[at])
        return at


@dataclass
class Ranker:
    columns: tuple[str, ...]
    edges: list[np.ndarray]
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def raw(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees[first:]:
            out += t.value[t.leaves(bins, self.depth) - (2**self.depth - 1)]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: how many edges lie below it."""
    return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def quantile_edges(rows: DataFrame, columns: tuple[str, ...], bins: int) -> list[np.ndarray]:
    shares = [(k + 1) / bins for k in range(bins - 1)]
    got = rows.agg(*[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), shares, 10_000).alias(f"c{k}") for k, c in enumerate(columns)]).head()
    return [np.unique(np.array(e or [], float)) for e in got]


def query_rows(rows: DataFrame, columns: tuple[str, ...], edges: list[np.ndarray], label: str | None = "y", block: str | None = None) -> DataFrame:
    """qid, block, ids, y, bins: a row per query; a query's documents are its candidates and fit one row."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    doc = F.struct("doc_id", (F.col(label).cast("double") if label else F.lit(0.0)).alias("y"), x.alias("x"))
    each = rows.groupBy("qid").agg((F.min(block).cast("int") if block else F.lit(-1)).alias("block"), F.array_sort(F.collect_list(doc)).alias("d"))
    kind, ids = rows.schema["qid"].dataType.simpleString(), rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column(4)).to_numpy()
            x = binned(b.column(4).flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns)), edges)
            at = [x[end - k : end].tobytes() for k, end in zip(n, np.cumsum(n))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(at, pa.binary())], names=["qid", "block", "ids", "y", "bins"])

    flat = each.select("qid", "block", F.col("d.doc_id").alias("ids"), F.col("d.y").alias("y"), F.col("d.x").alias("x"))
    return flat.mapInArrow(run, f"qid {kind}, block int, ids array<{ids}>, y array<double>, bins binary")


def grow(trees: list[Tree], sums: dict[tuple[int, int], np.ndarray], level: int, ridge: float, least: float, rate: float, depth: int) -> None:
    """Split every node of a level of each model's newest tree, or set the values of the last level, by sums[model, node][feature, bin] of (g, h)."""
    for (model, node), s in sums.items():
        tree = trees[model]
        if level == depth:
            g, h = s[0].sum(axis=0)
            tree.value[node - (2**depth - 1)] = -rate * g / (h + ridge)
            continue
        left = np.cumsum(s, axis=1)
        whole = left[:, -1:, :]
        right = whole - left
        score = lambda a: a[..., 0] ** 2 / (a[..., 1] + ridge)
        gain = np.where((left[..., 1] >= least) & (right[..., 1] >= least), score(left) + score(right) - score(whole), 0.0)
        # Sums differ in their last digits by the order of tasks, so gains are compared by twelve significant ones.
        top = gain.max()
        if top > 1e-12:
            f, b = np.argwhere(gain >= top * (1 - 1e-12))[0]
            tree.feature[node], tree.cut[node] = f, b


def fit_rankers(rows: DataFrame, columns: tuple[str, ...], blocks: list[int], block: str, trees: int = 20, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 1.0, least: float = 1e-3, top: int | None = None) -> dict[int, Ranker]:
    """A ranker for each of ``blocks``, fitted on the queries of all other blocks (-1: on all queries); rows have qid, doc_id, y, columns and the block."""
    edges = quantile_edges(rows, columns, bins)
    models = [Ranker(columns, edges, depth) for _ in blocks]
    width, inner = len(columns), 2**depth - 1
    with arrow_batches(rows.sparkSession, BATCH):
        data = checkpointed(query_rows(rows, columns, edges, "y", block).withColumn("score", F.array().cast("array<double>")))
    kept = 0

    def rescored(first: int) -> DataFrame:
        shared = [Ranker(m.columns, [], m.depth, m.trees[first:]) for m in models]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for r in b.select(["bins", "score"]).to_pylist():
                    x = np.frombuffer(r["bins"], np.uint8).reshape(-1, width)
                    new = np.stack([m.raw(x) for m in shared])
                    out.append(((np.array(r["score"]).reshape(new.shape) if r["score"] else 0) + new).ravel())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.float64()))], names=b.schema.names)

        with arrow_batches(rows.sparkSession, BATCH):
            return checkpointed(data.mapInArrow(run, data.schema))

    def level_sums(level: int, first: int) -> dict[tuple[int, int], np.ndarray]:
        whole = [Ranker(m.columns, [], m.depth, m.trees[first:-1]) for m in models]
        newest = [m.trees[-1] for m in models]
        low, nodes = 2**level - 1, 2**level
        used = width if level < depth else 1  # leaves need their totals only

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(whole), nodes * used * bins, 2))
            for b in batches:
                rows = [r for r in b.select(["block", "y", "bins", "score"]).to_pylist() if min(r["y"]) < max(r["y"])]
                if not rows:
                    continue
                n = np.array([len(r["y"]) for r in rows])
                ends = np.cumsum(n)
                x, y = np.frombuffer(b"".join(r["bins"] for r in rows), np.uint8).reshape(-1, width), np.concatenate([np.array(r["y"], float) for r in rows])
                own = np.repeat([r["block"] for r in rows], n)
                for k, model in enumerate(whole):
                    before = np.concatenate([np.array(r["score"]).reshape(len(whole), -1)[k] for r in rows]) if rows[0]["score"] else 0.0
                    score, g, h = before + model.raw(x), np.zeros(len(x)), np.zeros(len(x))
                    for start, end in zip(ends - n, ends):
                        if own[start] != blocks[k]:
                            g[start:end], h[start:end] = swap_gradients(y[start:end], score[start:end], top)
                    at = newest[k].leaves(x, level) - low
                    cell = (((at[:, None] * used + np.arange(used)) * bins) + x[:, :used]).ravel()
                    total[k, :, 0] += np.bincount(cell, np.repeat(g, used), nodes * used * bins)
                    total[k, :, 1] += np.bincount(cell, np.repeat(h, used), nodes * used * bins)
            total = total.reshape(len(whole), nodes, used, bins, 2)
            at = np.argwhere(total[..., 1] > 0)
            yield pa.RecordBatch.from_arrays([*[pa.array(at[:, j].astype(np.int32)) for j in range(4)], pa.array(total[tuple(at.T)][:, 0]), pa.array(total[tuple(at.T)][:, 1])], names=["model", "node", "feature", "bin", "g", "h"])

        parts = data.select("block", "y", "bins", "score").mapInArrow(run, "model int, node int, feature int, bin int, g double, h double")
        out: dict[tuple[int, int], np.ndarray] = {}
        with arrow_batches(rows.sparkSession, BATCH):
            got = parts.groupBy("model", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # models x nodes x features x bins
        for r in got:
            out.setdefault((r["model"], low + r["node"]), np.zeros((used, bins, 2)))[r["feature"], r["bin"]] = r["g"], r["h"]
        return out

    for t in range(trees):
        if t - kept == KEEP:
            data, kept = rescored(kept), t
        for m in models:
            m.trees.append(Tree(np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(inner + 1)))
        for level in range(depth + 1):
            grow([m.trees[-1] for m in models], level_sums(level, kept), level, ridge, least, rate, depth)
    return dict(zip(blocks, models))


def apply_rankers(rows: DataFrame, rankers: dict[int, Ranker], block: str | None = None) -> DataFrame:
    """qid, doc_id, score: each row by the ranker of its block, which has not seen it; by that of -1 where ``block`` is None."""
    columns = next(iter(rankers.values())).columns
    kinds = [rows.schema[c].dataType.simpleString() for c in ("qid", "doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = np.array(b.column(2).to_pylist(), np.int64)
            x, out = np.array(b.column(3).to_pylist(), float).reshape(-1, len(columns)), np.zeros(b.num_rows)
            for k, m in rankers.items():
                mine = of == k
                if mine.any():
                    out[mine] = m.raw(binned(x[mine], m.edges))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], names=["qid", "doc_id", "score"])

    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    rows = rows.select("qid", "doc_id", (F.col(block).cast("int") if block else F.lit(-1)).alias("block"), x.alias("x"))
    return rows.mapInArrow(run, f"qid {kinds[0]}, doc_id {kinds[1]}, score double")


def left_out_scores(rows: DataFrame, columns: tuple[str, ...], block: str, **how) -> DataFrame:
    """qid, doc_id, score of every row by a ranker fitted on the other blocks. There is a handful of blocks."""
    blocks = sorted(int(r[0]) for r in rows.select(block).distinct().collect())
    return apply_rankers(rows, fit_rankers(rows, columns, blocks, block, **how), block)

"""Scaling, folds, logistic rankers by distributed Newton steps, parameter sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.session import checkpointed


def standardise(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Population mean and deviation of each column; a zero deviation counts as 1."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"s_{c}") for c in columns])
    return rows.crossJoin(F.broadcast(stats)).select(*[c for c in rows.columns if c not in columns], *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in columns])


def stratified_folds(queries: DataFrame, folds: int = 5) -> DataFrame:
    """qid, fold: dealt in hash order within each stratum (gold count 0, 1, 2, more)."""
    stratum = F.least(F.col("g"), F.lit(3))
    return queries.select("qid", ((F.row_number().over(W.partitionBy(stratum).orderBy(F.md5(F.col("qid").cast("string").cast("binary")), "qid")) - 1) % folds).alias("fold"))


def fit_logistic(rows: DataFrame, columns: tuple[str, ...], c: float = 0.3, weight: str | None = None, intercept: bool = True, steps: int = 25) -> np.ndarray:
    """L2 logistic regression (the intercept is penalised too) by Newton steps.

    A step is one pass: a task adds up gradient and Gram matrix of its rows, and one aggregate sums these, so what
    reaches the driver has the size of the matrix. Null features count as 0.
    """
    n = len(columns) + intercept
    x = F.array(*[F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in columns], *([F.lit(1.0)] if intercept else []))
    base = checkpointed(rows.select(x.alias("x"), F.col("y").cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")))
    w = np.zeros(n)
    for _ in range(steps):

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n + 1, n))
            for b in batches:
                m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                y, v = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                p = 1 / (1 + np.exp(-np.clip(m @ w, -700, 700)))
                total[0] += (v * (p - y)) @ m
                total[1:] += (m * (v * p * (1 - p))[:, None]).T @ m
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

        total = np.zeros((n + 1) * n)
        for r in base.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():  # n (n + 1) sums
            total[r["cell"]] = r["v"]
        total = total.reshape(n + 1, n)
        step = np.linalg.solve(np.eye(n) + c * total[1:], total[0] * c + w)
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return w


def apply_logistic(rows: DataFrame, columns: tuple[str, ...], w: np.ndarray) -> DataFrame:
    m = sum((F.col(n) * float(v) for n, v in zip(columns, w)), F.lit(float(w[len(columns)]) if len(w) > len(columns) else 0.0))
    return rows.withColumn("p", 1 / (1 + F.exp(-m)))


def leave_block_out(rows: DataFrame, columns: tuple[str, ...], **how) -> DataFrame:
    """Score every fold by a model of the other folds; a handful of folds, each fit distributed."""
    out = None
    for fold in sorted(r[0] for r in rows.select("fold").distinct().collect()):
        w = fit_logistic(rows.where(F.col("fold") != fold), columns, **how)
        part = apply_logistic(rows.where(F.col("fold") == fold), columns, w)
        out = part if out is None else out.unionByName(part)
    return out


def support_grid(folds: DataFrame) -> DataFrame:
    """fold, outer_fold, support_fold: the folds whose labels a fold may learn from, never its own or the held-out one. There is a handful of folds."""
    names = sorted(r[0] for r in folds.select("fold").distinct().collect())
    return folds.sparkSession.createDataFrame([(a, o, x) for a in names for o in names for x in names if x not in (a, o)], "fold long, outer_fold long, support_fold long")


def crossfit_support(folds: DataFrame) -> DataFrame:
    """outer_fold, qid, support_fold: labels join on the fold, so no pair of queries is ever written."""
    return folds.join(F.broadcast(support_grid(folds)), "fold").select("outer_fold", "qid", "support_fold")


def sweep(runs: DataFrame, gold: DataFrame, params: DataFrame, depth: int = 5) -> DataFrame:
    """Recall of each configuration (config, branch, weight, k) of a rank fusion, all in one plan."""
    s = runs.join(F.broadcast(params), "branch").groupBy("config", "qid", "doc_id").agg(F.round(F.sum(F.col("weight") / (F.col("k") + F.col("rank"))), 9).alias("score"))
    top = s.withColumn("rank", F.row_number().over(W.partitionBy("config", "qid").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= depth)
    n = gold.groupBy("qid").agg(F.count("*").alias("g"))
    hits = top.join(gold, ["qid", "doc_id"]).groupBy("config", "qid").agg(F.count("*").alias("h"))
    grid = params.select("config").distinct().crossJoin(n)
    return grid.join(hits, ["config", "qid"], "left").groupBy("config").agg(F.avg(F.coalesce("h", F.lit(0)) / F.col("g")).alias("recall"))


def worst_block_choice(trials: DataFrame) -> DataFrame:
    """config, low, mean, precision, place: by the worst block's recall, then the mean, then the precision (config, block, recall, precision)."""
    per = trials.groupBy("config").agg(F.min("recall").alias("low"), F.avg("recall").alias("mean"), F.avg("precision").alias("precision"))
    return per.withColumn("place", F.row_number().over(W.orderBy(F.desc("low"), F.desc("mean"), F.desc("precision"), "config")))  # one row per configuration


def centroid(chosen: DataFrame, columns: tuple[str, ...], share: float = 0.02) -> DataFrame:
    """Mean of each column over the best ``share`` of the trials (one at least), made to sum to one; median of k."""
    n = F.count("*").over(W.partitionBy())
    top = chosen.withColumn("n", n).where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * share)))
    means = top.agg(*[F.avg(c).alias(c) for c in columns], F.percentile("k", 0.5).cast("int").alias("k"))
    whole = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return means.select(*[(F.col(c) / whole).alias(c) for c in columns], "k")


def safe_gate(splits: DataFrame) -> DataFrame:
    """config, safe, gain: safe if no split (config, losses, precision, base_precision, gain) loses a query or any precision."""
    ok = (F.col("losses") == 0) & (F.col("precision") >= F.col("base_precision"))
    return splits.groupBy("config").agg(F.bool_and(ok).cast("int").alias("safe"), F.sum("gain").alias("gain"))


def smallest_within(points: DataFrame, tolerances: tuple[float, ...] = (0.001, 0.003, 0.005)) -> DataFrame:
    """tolerance, id: of the points (id, recall, models, features) within a tolerance of the best recall the simplest."""
    t = points.sparkSession.createDataFrame([(x,) for x in tolerances], "tolerance double")
    best = points.agg(F.max("recall").alias("best"))
    j = points.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(t)).where(F.col("recall") >= F.col("best") - F.col("tolerance"))
    return j.groupBy("tolerance").agg(F.min(F.struct("models", "features", (-F.col("recall")).alias("less"), "id")).alias("m")).select("tolerance", F.col("m.id").alias("id"))

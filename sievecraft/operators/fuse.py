"""Rank fusion over long run tables (qid, branch, doc_id, rank, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rrf(runs: DataFrame, weights: dict, k: float, missing: int | None = 100_000, depth: int | dict | None = None, cap: int | None = None, pool: DataFrame | None = None) -> DataFrame:
    """qid, doc_id, score, rank: sum of weight / (k + rank).

    A branch that lacks a document counts with rank ``missing``, or not at all if that is None. ``pool`` restricts and
    completes the documents of each query. ``depth`` cuts the branches before, all alike or each by its own.
    """
    w = F.coalesce(*[F.when(F.col("branch") == b, F.lit(float(v))) for b, v in weights.items()], F.lit(0.0))
    own = runs.where(F.col("branch").isin(*weights))
    if depth is not None:
        deep = F.coalesce(*[F.when(F.col("branch") == b, F.lit(d)) for b, d in depth.items()]) if isinstance(depth, dict) else F.lit(depth)
        own = own.where(F.col("rank") <= F.coalesce(deep, F.col("rank")))
    gain = w / (k + F.col("rank")) - (w / (k + missing) if missing is not None else F.lit(0.0))
    got = own.groupBy("qid", "doc_id").agg(F.sum(gain).alias("g"))
    if pool is not None:
        got = pool.select("qid", "doc_id").join(got, ["qid", "doc_id"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    base = sum(weights.values()) / (k + missing) if missing is not None else 0.0
    out = got.select("qid", "doc_id", F.round(F.col("g") + base, 9).alias("score"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))
    return out if cap is None else out.where(F.col("rank") <= cap)


def z_blend(runs: DataFrame, pool: DataFrame, branches: tuple) -> DataFrame:
    """Sum of per-query z-scores; a missing score is the mean less two standard deviations (z = -2)."""
    grid = pool.select("qid", "doc_id").crossJoin(F.broadcast(pool.sparkSession.createDataFrame([(b,) for b in branches], "branch string")))
    s = grid.join(runs.select("qid", "branch", "doc_id", "score"), ["qid", "branch", "doc_id"], "left")
    q = W.partitionBy("qid", "branch")
    z = (F.col("score") - F.avg("score").over(q)) / F.coalesce(F.nullif(F.stddev_pop("score").over(q), F.lit(0.0)), F.lit(1.0))
    return s.withColumn("z", F.coalesce(z, F.lit(-2.0))).groupBy("qid", "doc_id").agg(F.sum("z").alias("score"))


def graph_strength(edges: DataFrame, freq: DataFrame, mode: str, min_edge: int = 1) -> DataFrame:
    """src, dst, strength: conditional, cosine, jaccard or lift of the counts of edges that ``min_edge`` questions share at least."""
    e = edges.where(F.col("cnt") >= min_edge).join(freq.select(F.col("doc_id").alias("src"), F.col("n").alias("fs")), "src").join(freq.select(F.col("doc_id").alias("dst"), F.col("n").alias("fd")), "dst")
    smooth = (F.col("fs") + 0.5) * (F.col("fd") + 0.5)
    how = {
        "conditional": F.col("cnt") / (F.col("fs") + 1),
        "cosine": F.col("cnt") / F.sqrt(smooth),
        "jaccard": F.col("cnt") / (F.col("fs") + F.col("fd") - F.col("cnt") + 1),
        "lift": F.col("cnt") / F.pow(smooth, F.lit(0.35)),
    }[mode]
    return e.select("src", "dst", how.alias("strength"))


def graph_rerank(ranking: DataFrame, strengths: DataFrame, seeds: int = 5, base_k: float = 10.0, alpha: float = 0.3, power: float = 1.0) -> DataFrame:
    """1/(base_k + pos) + alpha (g/gmax)/(base_k + 1), with g summed over the neighbours of the first documents, each by its rank to the ``power``."""
    g = ranking.where(F.col("rank") <= seeds).join(strengths, ranking["doc_id"] == strengths["src"]).groupBy("qid", F.col("dst").alias("doc_id")).agg(F.sum(F.col("strength") / F.pow(F.col("rank"), F.lit(float(power)))).alias("g"))
    both = ranking.select("qid", "doc_id", "rank").join(g, ["qid", "doc_id"], "full")
    both = both.withColumn("gm", F.max("g").over(W.partitionBy("qid")))
    score = 1 / (base_k + F.coalesce("rank", F.lit(100_000))) + alpha * F.coalesce(F.col("g") / F.nullif(F.col("gm"), F.lit(0.0)), F.lit(0.0)) / (base_k + 1)
    return both.select("qid", "doc_id", F.round(score, 9).alias("score"))

"""Evaluation and audit aggregates over run and gold tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.session import checkpointed


def query_metrics(run: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: recall at 5 and 100, MRR at 10, nDCG at 10, precision at 5; queries without a ranking score 0."""
    hits = gold.join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    at = lambda k: F.count(F.when(F.col("rank") <= k, 1))
    m = hits.groupBy("qid").agg(
        F.count("*").alias("g"), at(5).alias("h5"), at(100).alias("h100"), F.min("rank").alias("first"),
        F.coalesce(F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("g"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    return m.select(
        "qid", "g", (F.col("h5") / F.col("g")).alias("recall5"), (F.col("h100") / F.col("g")).alias("recall100"), (F.col("h5") / 5).alias("precision5"),
        F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0).alias("mrr10"), (F.col("dcg") / ideal).alias("ndcg10"),
    )


def ndcg_of_lists(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """qid, ndcg10 from each query's first ``k`` answers and its set of gold ids, a second route to that of query_metrics."""
    answers = run.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_list(F.struct("rank", "doc_id")).alias("a"))
    j = gold.groupBy("qid").agg(F.collect_set("doc_id").alias("g")).join(answers, "qid", "left")
    gain = lambda rank: F.lit(1.0) / (F.log(rank + 1.0) / F.log(F.lit(2.0)))
    total = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda s, r: s + gain(r))
    hits = F.transform(F.filter("a", lambda x: F.array_contains("g", x["doc_id"])), lambda x: x["rank"].cast("int"))
    return j.select("qid", (F.coalesce(total(hits), F.lit(0.0)) / total(F.sequence(F.lit(1), F.least(F.size("g"), F.lit(k))))).alias("ndcg10"))


def pooled(metrics: DataFrame) -> DataFrame:
    p, r = F.avg("precision5"), F.avg("recall5")
    return metrics.agg(F.count("*").alias("n"), r.alias("recall5"), F.avg("recall100").alias("recall100"), F.avg("mrr10").alias("mrr10"), F.avg("ndcg10").alias("ndcg10"), p.alias("precision5"), F.coalesce(5 * p * r / F.nullif(4 * p + r, F.lit(0.0)), F.lit(0.0)).alias("f2"))


def official(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: recall and precision of an answer list, both 0 unless it has 1 to 5 ids."""
    a = answers.groupBy("qid").agg(F.collect_set("doc_id").alias("a"))
    g = gold.groupBy("qid").agg(F.collect_set("doc_id").alias("g")).join(a, "qid", "left")
    n = F.coalesce(F.size("a"), F.lit(0))
    hit = F.size(F.array_intersect("a", "g"))
    ok = n.between(1, 5)
    return g.select("qid", F.when(ok, hit / F.size("g")).otherwise(0.0).alias("recall"), F.when(ok, hit / n).otherwise(0.0).alias("precision"))


def fold_slices(metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """Recall by fold and over all, with single- and multi-answer slices, in one pass of grouping sets."""
    m = metrics.join(folds, "qid")
    return m.cube("fold").agg(F.count("*").alias("n"), F.avg("recall5").alias("recall5"), F.avg(F.when(F.col("g") == 1, F.col("recall5"))).alias("single"), F.avg(F.when(F.col("g") > 1, F.col("recall5"))).alias("multi"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    j = before.select("qid", F.col("recall5").alias("a")).join(after.select("qid", F.col("recall5").alias("b")), "qid")
    return j.agg(F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("b") == F.col("a")).alias("ties"), F.avg(F.col("b") - F.col("a")).alias("delta"))


def transitions(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    j = gold.join(before.select("qid", "doc_id", F.col("rank").alias("rb")), ["qid", "doc_id"], "left").join(after.select("qid", "doc_id", F.col("rank").alias("ra")), ["qid", "doc_id"], "left")
    return j.groupBy(X.rank_bucket(F.col("rb")).alias("before"), X.rank_bucket(F.col("ra")).alias("after")).agg(F.count("*").alias("n"))


def recall_curve(run: DataFrame, gold: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    d = gold.sparkSession.createDataFrame([(x,) for x in depths], "depth int")
    hits = gold.join(run.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left").crossJoin(F.broadcast(d))
    per = hits.groupBy("depth", "qid").agg((F.count_if(F.col("rank") <= F.col("depth")) / F.count("*")).alias("r"))
    return per.groupBy("depth").agg(F.avg("r").alias("recall"))


def union_oracle(runs: DataFrame, gold: DataFrame, depth: int = 5) -> DataFrame:
    """Per branch: answers that it alone has in its first ``depth``; and how many any branch has."""
    top = runs.where(F.col("rank") <= depth).select("qid", "doc_id", "branch").join(gold, ["qid", "doc_id"], "left_semi")
    owners = top.withColumn("n", F.count("*").over(W.partitionBy("qid", "doc_id")))
    return owners.groupBy("branch").agg(F.count("*").alias("found"), F.count_if(F.col("n") == 1).alias("alone"))


def boundary_accuracy(run: DataFrame, gold: DataFrame, low: int = 4, high: int = 20) -> DataFrame:
    """Share of (answer, other) pairs of the band in which the answer scores higher."""
    band = run.where(F.col("rank").between(low, high)).join(gold.withColumn("y", F.lit(1)), ["qid", "doc_id"], "left")
    p, n = band.where("y = 1").select("qid", F.col("score").alias("sp")), band.where("y is null").select("qid", F.col("score").alias("sn"))
    return p.join(n, "qid").agg(F.count("*").alias("pairs"), F.avg((F.col("sp") > F.col("sn")).cast("double")).alias("accuracy"))


def order_statistic(values: DataFrame, share: float = 0.95) -> DataFrame:
    """Mean, and the value at position int(share * n) of the sorted list (no interpolation).

    Approximate bounds around the share leave a narrow band of values; only its distinct values are put in order, with
    the values below it counted. The bounds are off by a ten-thousandth of the rows at most.
    """
    values = values.where("v is not null")
    low, high = F.percentile_approx("v", max(0.0, share - 0.002), 10_000), F.percentile_approx("v", min(1.0, share + 0.002), 10_000)
    n = values.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), low.alias("low"), high.alias("high"))
    each = values.crossJoin(F.broadcast(n))  # one row
    below = each.agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
    band = each.where("v >= low and v <= high").groupBy("v", "n", "mean").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    placed = band.crossJoin(F.broadcast(below)).withColumn("upto", F.col("below") + upto)
    at = F.floor(F.col("n") * share)
    return placed.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select("n", "mean", F.col("v").alias("p95"))


def bootstrap(deltas: DataFrame, samples: int = 20_000, seed: int = 112, block: int = 4096) -> DataFrame:
    """Paired bootstrap of the mean of ``deltas`` (delta), without gathering them.

    Equal deltas are one row with their number; these rows are dealt into blocks of about ``block``. How many of a
    sample's draws fall to a block is found by splitting them at each fork of a binary tree over the blocks (binomial
    draws from a generator that is named by seed and fork, so every task that passes a fork sees the same), and within
    a block by a multinomial draw. A block hands on one sum per sample.
    """
    counted = checkpointed(deltas.where("delta is not null").groupBy("delta").agg(F.count("*").alias("n")))
    blocks = max(1, -(-counted.count() // block))
    counted = counted.withColumn("block", F.pmod(F.xxhash64("delta"), F.lit(blocks)).cast("int"))
    sizes = {r["block"]: r["n"] for r in counted.groupBy("block").agg(F.sum("n").alias("n")).collect()}  # one number per block
    size = np.array([sizes.get(k, 0) for k in range(blocks)], np.int64)

    def draws_of(leaf: int) -> np.ndarray:
        low, high, fork, mine = 0, blocks, 1, np.full(samples, size.sum())
        while high - low > 1:
            mid, whole = (low + high) // 2, size[low:high].sum()
            left = np.random.default_rng([seed, 1, fork]).binomial(mine, size[low:mid].sum() / whole if whole else 0.0)
            if leaf < mid:
                high, mine, fork = mid, left, 2 * fork
            else:
                low, mine, fork = mid, mine - left, 2 * fork + 1
        return mine

    def run(t: pa.Table) -> pa.Table:
        leaf = t.column("block")[0].as_py()
        d, n = t.column("delta").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(d, kind="stable")
        d, n = d[order], n[order]
        rng, mine, sums = np.random.default_rng([seed, 2, leaf]), draws_of(leaf), np.zeros(samples)
        for at in range(0, samples, 500):
            sums[at : at + 500] = rng.multinomial(mine[at : at + 500], n / n.sum()) @ d
        return pa.table({"id": pa.array(np.arange(samples)), "sum": pa.array(sums)})

    m = counted.groupBy("block").applyInArrow(run, "id long, sum double").groupBy("id").agg((F.sum("sum") / int(size.sum() or 1)).alias("mean"))
    observed = counted.agg((F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("observed"))
    share = lambda c: F.avg(c.cast("double"))
    stats = m.agg(
        F.lit(seed).alias("seed"), F.count("*").alias("samples"), F.avg("mean").alias("mean"), F.percentile("mean", 0.5).alias("median"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"),
        share(F.col("mean") > 0).alias("p_positive"), share(F.col("mean") >= 0.005).alias("p_half_percent"),
    )
    return stats.crossJoin(F.broadcast(observed))  # one row each


def ceilings(pool: DataFrame, dense: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the recall of a dense run at four depths, of the pool, and of both together; answers that the run rescues, and that neither reaches."""
    j = gold.join(pool.select("qid", "doc_id", F.lit(True).alias("p")).distinct(), ["qid", "doc_id"], "left").join(dense.select("qid", "doc_id", "rank"), ["qid", "doc_id"], "left")
    inside = F.col("p").isNotNull()
    upto = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    per = {f"dense{k}": upto(k) for k in (5, 20, 50, 100)} | {"ceiling": inside} | {f"ceiling_dense{k}": inside | upto(k) for k in (10, 20, 50)}
    q = j.groupBy("qid").agg(*[F.avg(c.cast("double")).alias(n) for n, c in per.items()], F.count_if(upto(20) & ~inside).alias("rescued"), F.count_if(~inside & ~upto(100)).alias("unreachable"))
    return q.agg(F.count("*").alias("queries"), *[F.avg(n).alias(n) for n in per], F.sum("rescued").alias("rescued"), F.sum("unreachable").alias("unreachable"))


def choice_oracle(runs: DataFrame, gold: DataFrame, depth: int = 5) -> DataFrame:
    """One row of mean recalls: all that any branch has in its first ``depth``; the best ``depth`` chosen of these; the best single branch of each query."""
    hits = gold.join(runs.where(F.col("rank") <= depth).select("qid", "doc_id", "branch"), ["qid", "doc_id"], "left")
    single = hits.groupBy("qid", "branch").agg(F.count("branch").alias("h")).groupBy("qid").agg(F.max("h").alias("best"))
    per = hits.groupBy("qid", "doc_id").agg((F.count("branch") > 0).cast("int").alias("found")).groupBy("qid").agg(F.count("*").alias("g"), F.sum("found").alias("found")).join(single, "qid")
    return per.agg(F.count("*").alias("queries"), F.avg(F.col("found") / F.col("g")).alias("union"), F.avg(F.least(F.lit(depth), "found") / F.col("g")).alias("choice"), F.avg(F.col("best") / F.col("g")).alias("branch"))


def rescues(missed: DataFrame, other: DataFrame, gold: DataFrame, depth: int = 5) -> DataFrame:
    """bucket, n: where the answers that ``other`` has in its first ``depth`` and ``missed`` has not stand in ``missed``."""
    own = missed.select("qid", "doc_id", F.col("rank").alias("rm"))
    found = gold.join(other.where(F.col("rank") <= depth).select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").join(own, ["qid", "doc_id"], "left")
    return found.where(F.col("rm").isNull() | (F.col("rm") > depth)).groupBy(X.rank_bucket(F.col("rm")).alias("bucket")).agg(F.count("*").alias("n"))


def coverage(pool: DataFrame, runs: DataFrame) -> DataFrame:
    """branch, coverage: the mean share of a query's pool that the branch has."""
    branches = runs.select("branch").distinct()
    sized = pool.groupBy("qid").agg(F.count("*").alias("size"))
    held = pool.join(runs.select("qid", "doc_id", "branch").distinct(), ["qid", "doc_id"]).groupBy("branch", "qid").agg(F.count("*").alias("n"))
    grid = sized.crossJoin(F.broadcast(branches))  # a handful of branches
    return grid.join(held, ["branch", "qid"], "left").groupBy("branch").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("size")).alias("coverage"))


def compare_by_fold(before: DataFrame, after: DataFrame, gold: DataFrame, folds: DataFrame, depth: int = 5) -> DataFrame:
    """One row: queries, mean change of recall, worst fold's change, wins, losses, ties, changed answer sets, answers in and out."""
    top = lambda r, name: r.where(F.col("rank") <= depth).groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias(name))
    none = F.array().cast(gold.select(F.array("doc_id").alias("a")).schema["a"].dataType)
    j = gold.groupBy("qid").agg(F.collect_set("doc_id").alias("g")).join(top(before, "a"), "qid", "left").join(top(after, "b"), "qid", "left").join(folds, "qid")
    j = j.withColumn("a", F.coalesce("a", none)).withColumn("b", F.coalesce("b", none))
    hit = lambda c: F.size(F.array_intersect(c, "g"))
    j = j.withColumn("delta", (hit("b") - hit("a")) / F.size("g")).withColumn("into", F.size(F.array_except(F.array_intersect("b", "g"), "a"))).withColumn("out", F.size(F.array_except(F.array_intersect("a", "g"), "b")))
    counts = [F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"), F.count_if(F.col("a") != F.col("b")).alias("churn"), F.sum("into").alias("into"), F.sum("out").alias("out")]
    per = j.groupBy("fold").agg(F.count("*").alias("n"), F.sum("delta").alias("sum"), F.avg("delta").alias("mean"), *counts)
    names = ("wins", "losses", "ties", "churn", "into", "out")
    return per.agg(F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("delta"), F.min("mean").alias("worst_fold"), *[F.sum(c).alias(c) for c in names])


def weighted_mean(per_fold: DataFrame, columns: tuple[str, ...], n: str = "n") -> DataFrame:
    """Metrics of folds pooled by their numbers of queries."""
    return per_fold.agg(F.sum(n).alias(n), *[(F.sum(F.col(c) * F.col(n)) / F.sum(n)).alias(c) for c in columns])


def complexity(used: DataFrame, sizes: DataFrame) -> DataFrame:
    """config, models, parameters of the distinct models that a configuration uses (config, model; model, parameters)."""
    return used.select("config", "model").distinct().join(sizes, "model").groupBy("config").agg(F.count("*").alias("models"), F.sum("parameters").alias("parameters"))


def bad_share(scores: DataFrame, most: float = 0.5) -> DataFrame:
    """label, n, bad, failed: scores that are not finite, and whether their share exceeds ``most``."""
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    return scores.groupBy("label").agg(F.count("*").alias("n"), F.count_if(~ok).alias("bad")).withColumn("failed", (F.col("bad") > most * F.col("n")).cast("int"))


def pooled_scores(passages: DataFrame, depth: int, how: str = "max", floor: float = -1e9) -> DataFrame:
    """qid, doc_id, score: the largest or mean finite score of a document's first ``depth`` passages; the floor if none is finite."""
    ok = (F.col("passage") <= depth) & ~F.isnan("score") & (F.abs("score") < float("inf"))
    got = {"max": F.max, "mean": F.avg}[how](F.when(ok, F.col("score")))
    return passages.groupBy("qid", "doc_id").agg(F.coalesce(got, F.lit(floor)).alias("score"))


def headroom(runs: DataFrame, gold: DataFrame, depths: tuple[int, ...] = (5, 20, 50, 100)) -> DataFrame:
    """depth, hits of each branch alone and of the union of all branches, in answers found (branch null: the union)."""
    d = gold.sparkSession.createDataFrame([(x,) for x in depths], "depth int")
    hit = runs.select("qid", "doc_id", "branch", "rank").join(gold, ["qid", "doc_id"], "left_semi")
    best = hit.select("qid", "doc_id", "rank", "branch").unionByName(hit.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank")).withColumn("branch", F.lit("all")))
    return best.crossJoin(F.broadcast(d)).groupBy("depth", "branch").agg(F.count_if(F.col("rank") <= F.col("depth")).alias("found"))

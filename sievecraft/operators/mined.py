"""Rows mined for learners: features of question memory, quotas of hard negatives, swaps of the last answer by utility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.operators import learn

#: Numbers of negatives taken from each source, in this order.
QUOTAS = {"hardest": 16, "middle": 16, "disagreement": 16, "confuser": 8, "random": 8}
MEMORY = "n best mean total votes votes_sq rr first n1 n5 n20 share freq prior".split()


def memory_rows(pool: DataFrame, neighbours: DataFrame, golds: DataFrame) -> DataFrame:
    """qid, doc_id and 14 features of how the neighbours (qid, other, score, rank) of a query answer with a document.

    Their number, best, mean and total score; votes by score/(10 + rank) and by the score's square; the sum of 1/rank and
    the best rank (0 if none); how many are among the first 1, 5 and 20; the share of neighbours; the number of answers
    (of other queries) that name the document, and its logarithm over the largest in the query's pool.
    """
    size = neighbours.groupBy("qid").agg(F.count("*").alias("size"))
    g = golds.select(F.col("qid").alias("other"), "doc_id").distinct()
    hit = neighbours.join(g, "other").join(pool.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    s, r = F.greatest(F.col("score"), F.lit(0.0)), F.col("rank")
    per = hit.groupBy("qid", "doc_id").agg(
        F.count("*").alias("n"), F.max(s).alias("best"), F.avg(s).alias("mean"), F.sum(s).alias("total"), F.sum(s / (10 + r)).alias("votes"), F.sum(s * s).alias("votes_sq"), F.sum(1 / r).alias("rr"), F.min(r).alias("first"),
        F.count_if(r <= 1).alias("n1"), F.count_if(r <= 5).alias("n5"), F.count_if(r <= 20).alias("n20"),
    )
    named = g.groupBy("doc_id").agg(F.count("*").alias("f"))
    own = g.withColumnRenamed("other", "qid").withColumn("own", F.lit(1))
    j = pool.select("qid", "doc_id").join(per, ["qid", "doc_id"], "left").join(size, "qid", "left").join(named, "doc_id", "left").join(own, ["qid", "doc_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    freq = F.coalesce("f", F.lit(0)) - F.coalesce("own", F.lit(0))
    j = j.select("qid", "doc_id", *[zero(c) for c in MEMORY[:11]], F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)).alias("share"), freq.cast("double").alias("freq"))
    return j.withColumn("prior", F.log1p("freq") / F.greatest(F.max(F.log1p("freq")).over(W.partitionBy("qid")), F.lit(1.0)))


def _lists(rows: DataFrame, name: str, order: Column, most: int | None = None) -> DataFrame:
    """qid and the array of its documents in ``order``, with ties to the smaller id; of ``most`` at the most."""
    ranked = rows.select("qid", "doc_id", order.alias("o"))
    if most is not None:
        ranked = ranked.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy("o", "doc_id"))).where(F.col("n") <= most)
    return ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "doc_id"))), lambda x: x["doc_id"]).alias(name))


def shuffled(epoch: int) -> Column:
    """A place that depends on query, document and epoch alone, so that a rerun draws the same."""
    return F.md5(F.concat_ws(":", "qid", F.lit(epoch), "doc_id").cast("binary"))


def quota_negatives(current: DataFrame, first: DataFrame, second: DataFrame, confuser: DataFrame, universe: DataFrame, gold: DataFrame, epoch: int = 0, quotas: dict[str, int] | None = None, bucket: int = 1024) -> DataFrame:
    """qid, doc_id, source, pick: negatives of every query of ``current`` by quotas; a document is taken once.

    The lists have (qid, doc_id, rank); ``universe`` has doc_id. In this order: the hardest of the current list; a draw
    of its ranks after them up to 100; a draw of those documents of two sparse lists that stand at equal places in both
    lists' common length and are not among the hardest; the first of a confuser list; random documents. What is still
    lacking follows from the current list, then from the random documents. No answer of the query is taken.

    Random documents come from one of the universe's buckets (about ``bucket`` documents by a hash), drawn by query and
    epoch, so no query meets the whole universe. With no more than ``bucket`` documents all of them are met. Where a
    bucket and the lists hold too few, fewer negatives are returned.
    """
    take = QUOTAS | (quotas or {})
    hard, want = take["hardest"], sum(take.values())
    # Answers and earlier picks block at most this many places, so longer lists hold nothing that could be taken.
    deep = gold.groupBy("qid").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] + want + 100
    depth = F.least(*[F.coalesce(F.col(c), F.lit(0)) for c in ("da", "db")])
    both = first.groupBy("qid").agg(F.max("rank").alias("da")).join(second.groupBy("qid").agg(F.max("rank").alias("db")), "qid")
    top = current.where(F.col("rank") <= hard).select("qid", "doc_id")
    sparse = first.select("qid", "doc_id", "rank").unionByName(second.select("qid", "doc_id", "rank")).join(both, "qid").where(F.col("rank") <= depth).select("qid", "doc_id").distinct().join(top, ["qid", "doc_id"], "left_anti")
    parts = max(1, universe.count() // bucket)
    spread = universe.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"))
    some = current.select("qid").distinct().withColumn("part", F.pmod(F.xxhash64("qid", F.lit(epoch)), F.lit(parts))).join(spread, "part").select("qid", "doc_id")
    named = {
        "now": _lists(current, "now", F.col("rank"), deep), "middle": _lists(current.where(F.col("rank").between(hard + 1, 100)), "middle", shuffled(epoch)), "disagreement": _lists(sparse, "disagreement", shuffled(epoch), deep),
        "confuser": _lists(confuser, "confuser", F.col("rank"), deep), "random": _lists(some, "random", shuffled(epoch), deep), "blocked": gold.groupBy("qid").agg(F.collect_set("doc_id").alias("blocked")),
    }
    j = current.select("qid").distinct()
    for x in named.values():
        j = j.join(x, "qid", "left")
    kind = F.array().cast(current.select(F.array("doc_id")).schema[0].dataType)
    j = j.select("qid", *[F.coalesce(F.col(c), kind).alias(c) for c in named]).withColumn("got", kind)
    steps = [("hardest", "now"), *[(k, k) for k in ("middle", "disagreement", "confuser", "random")], ("backfill", "now"), ("backfill_random", "random")]
    for label, source in steps:  # seven steps, whatever the data
        free = F.array_except(F.array_except(source, "blocked"), "got")
        n = F.lit(take[label]) if label in take else F.greatest(F.lit(want) - F.size("got"), F.lit(0))
        j = j.withColumn(f"p_{label}", F.slice(free, F.lit(1), n)).withColumn("got", F.concat("got", f"p_{label}"))
    named_as = lambda label: F.transform(f"p_{label}", lambda x: F.struct(x.alias("doc_id"), F.lit(label).alias("source")))
    picked = F.concat(*[named_as(label) for label, _ in steps])
    return j.select("qid", F.posexplode(picked).alias("pos", "x")).select("qid", "x.doc_id", "x.source", (F.col("pos") + 1).alias("pick"))


def action_targets(actions: DataFrame, gold: DataFrame, idle: float = 0.15) -> DataFrame:
    """Adds target (what the metric gains if the challenger takes the incumbent's place) and weight (``idle`` where it gains nothing).

    Queries without an answer have nothing to gain and go.
    """
    n = gold.groupBy("qid").agg(F.countDistinct("doc_id").alias("__n"))
    g = gold.select("qid", "doc_id").distinct().withColumn("__y", F.lit(1.0))
    side = lambda c, y: g.select("qid", F.col("doc_id").alias(c), F.col("__y").alias(y))
    j = actions.join(n, "qid").join(side("challenger", "__c"), ["qid", "challenger"], "left").join(side("incumbent", "__i"), ["qid", "incumbent"], "left")
    j = j.withColumn("target", (F.coalesce("__c", F.lit(0.0)) - F.coalesce("__i", F.lit(0.0))) / F.col("__n"))
    return j.withColumn("weight", F.when(F.col("target") != 0, 1.0).otherwise(idle)).drop("__n", "__c", "__i")


def swapped(run: DataFrame, utilities: DataFrame, at: int = 5) -> DataFrame:
    """qid, doc_id, rank of the first ``at``: the challenger of the largest utility (qid, challenger, new_rank, utility) takes the last place if that is above 0.

    Of equal utilities the better rank is taken.
    """
    best = utilities.groupBy("qid").agg(F.max(F.struct("utility", -F.col("new_rank"), "challenger")).alias("b")).where("b.utility > 0").select("qid", F.lit(at).cast("long").alias("rank"), F.col("b.challenger").alias("new"))
    return run.where(F.col("rank") <= at).select("qid", "doc_id", F.col("rank").cast("long").alias("rank")).join(best, ["qid", "rank"], "left").select("qid", F.coalesce("new", "doc_id").alias("doc_id"), "rank")


def utility_gate(actions: DataFrame, columns: tuple[str, ...], trees: int = 20, depth: int = 3, step: float = 0.05) -> DataFrame:
    """qid, challenger, new_rank, utility: boosted regression trees of the other folds score each action (fold, target, weight)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = VectorAssembler(inputCols=list(columns), outputCol="__x").transform(actions)
    booster = GBTRegressor(featuresCol="__x", labelCol="target", weightCol="weight", predictionCol="utility", maxIter=trees, maxDepth=depth, stepSize=step, minInstancesPerNode=20, subsamplingRate=0.85, seed=7)
    out = None
    for fold in sorted(r[0] for r in actions.select("fold").distinct().collect()):  # a handful of folds
        part = booster.fit(x.where(F.col("fold") != fold)).transform(x.where(F.col("fold") == fold)).select("qid", "challenger", "new_rank", "utility")
        out = part if out is None else out.unionByName(part)
    return out


def named_in_question(pool: DataFrame, questions: DataFrame, owners: DataFrame) -> DataFrame:
    """qid, doc_id, named: 1 where a question (qid, numbers) names the document's own number (doc_id, own)."""
    asked = questions.select("qid", F.explode("numbers").alias("own")).distinct()
    hit = owners.where("own is not null").join(asked, "own").select("qid", "doc_id").distinct().withColumn("named", F.lit(1.0))
    return pool.select("qid", "doc_id").join(hit, ["qid", "doc_id"], "left").withColumn("named", F.coalesce("named", F.lit(0.0)))


def crossfit_frequency(folds: DataFrame, gold: DataFrame) -> DataFrame:
    """outer_fold, qid, doc_id, freq: how often a query's answers are named in the folds it may learn from.

    Counts are taken per fold and document first, so no pair of queries is ever written.
    """
    f, allowed = folds.select("qid", "fold"), learn.support_grid(folds)
    per = gold.join(f, "qid").groupBy(F.col("fold").alias("support_fold"), "doc_id").agg(F.count("*").alias("n"))
    of = per.join(F.broadcast(allowed), "support_fold").groupBy("outer_fold", "fold", "doc_id").agg(F.sum("n").alias("freq"))
    mine = gold.join(f, "qid").join(F.broadcast(allowed.select("outer_fold", "fold").distinct()), "fold")
    return mine.join(of, ["outer_fold", "fold", "doc_id"], "left").select("outer_fold", "qid", "doc_id", F.coalesce("freq", F.lit(0)).alias("freq"))

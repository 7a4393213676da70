"""Joins and set operations on candidate lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.session import checkpointed


def pool_union(lists: DataFrame) -> DataFrame:
    """qid, doc_id, pool_pos: ordered distinct union of lists with (qid, doc_id, src, pos)."""
    first = lists.groupBy("qid", "doc_id").agg(F.min(F.struct("src", "pos")).alias("o"))
    return first.select("qid", "doc_id", F.row_number().over(W.partitionBy("qid").orderBy("o", "doc_id")).alias("pool_pos"))


def churn(before: DataFrame, after: DataFrame, depth: int = 5) -> DataFrame:
    """qid, set_differs, order_differs of the first ``depth`` documents; shared and gone count them."""
    top = lambda r, name: r.where(F.col("rank") <= depth).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    j = top(before, "a").join(top(after, "b"), "qid")
    return j.select("qid", (F.array_sort("a") != F.array_sort("b")).cast("int").alias("set_differs"), (F.col("a") != F.col("b")).cast("int").alias("order_differs"), F.size(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_except("a", "b")).alias("gone"))


def fill_from_all(answers: DataFrame, ids: DataFrame, n: int = 5) -> DataFrame:
    """Fill answer lists that are still short from the ids of all documents, in their order.

    The first 2 n ids suffice for any list of fewer than n, whatever it holds.
    """
    spare = ids.orderBy("doc_id").limit(2 * n).withColumn("pos", F.row_number().over(W.orderBy("doc_id")))
    some = answers.select("qid").distinct().crossJoin(F.broadcast(spare))
    both = answers.select("qid", "doc_id", F.lit(0).alias("src"), F.col("pool_pos").alias("pos")).unionByName(some.select("qid", "doc_id", F.lit(1).alias("src"), "pos"))
    return pool_union(both).where(F.col("pool_pos") <= n)


def backfill(answers: DataFrame, candidates: DataFrame, n: int = 5) -> DataFrame:
    """Fill each answer list up to n with the next candidates."""
    both = answers.select("qid", "doc_id", F.lit(0).alias("src"), F.col("rank").alias("pos")).unionByName(candidates.select("qid", "doc_id", F.lit(1).alias("src"), F.col("rank").alias("pos")))
    return pool_union(both).where(F.col("pool_pos") <= n)


def canonical(gold: DataFrame, aliases: DataFrame, empty: DataFrame) -> DataFrame:
    """Map duplicate ids to the id that stays, drop ids of empty documents."""
    g = gold.join(aliases, "doc_id", "left").select("qid", F.coalesce("kept_id", "doc_id").alias("doc_id"))
    return g.join(empty, "doc_id", "left_anti").distinct()


def with_default(pool: DataFrame, scores: DataFrame, default: Column) -> DataFrame:
    return pool.join(scores, ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", default))


def cooccurrence(gold: DataFrame) -> DataFrame:
    a, b = gold.select("qid", F.col("doc_id").alias("src")), gold.select("qid", F.col("doc_id").alias("dst"))
    return a.join(b, "qid").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("cnt"))


def citations(pool: DataFrame, numbers: DataFrame) -> DataFrame:
    """qid, doc_id, cited_by, cites_in_pool, n_cited, has_own: from (doc_id, own, cited); an equi-join on the number."""
    p = pool.select("qid", "doc_id").join(numbers, "doc_id")
    cites = p.select("qid", F.col("doc_id").alias("by"), F.explode("cited").alias("number"))
    owns = p.where("own is not null").select("qid", F.col("doc_id").alias("of"), F.col("own").alias("number"))
    links = cites.join(owns, ["qid", "number"]).where("by <> of")
    cited_by = links.groupBy("qid", F.col("of").alias("doc_id")).agg(F.countDistinct("by").alias("cited_by"))
    citing = links.groupBy("qid", F.col("by").alias("doc_id")).agg(F.countDistinct("of").alias("cites_in_pool"))
    out = p.join(cited_by, ["qid", "doc_id"], "left").join(citing, ["qid", "doc_id"], "left")
    return out.select("qid", "doc_id", F.coalesce("cited_by", F.lit(0)).alias("cited_by"), F.coalesce("cites_in_pool", F.lit(0)).alias("cites_in_pool"), F.size("cited").alias("n_cited"), F.col("own").isNotNull().cast("int").alias("has_own"))


#: What a configuration is judged by: more recall, fewer models and features.
CRITERIA = (("recall", True), ("models", False), ("features", False))


def pareto(rows: DataFrame, criteria: tuple[tuple[str, bool], ...] = CRITERIA, strict: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that no other row dominates: the frontier of an experiment list. Criteria are (column, whether more is better).

    A row dominates another if it is no worse in every criterion and better in one of ``strict`` (all of them for None).
    Rows without one of the criteria dominate nothing and are not dominated. Every task keeps the frontier of its rows,
    taken in the order of the criteria so that a row meets those that may dominate it first; frontiers are merged in
    rounds of ever fewer tasks, the last of which holds the result alone.
    """
    names = [c for c, _ in criteria]
    sign = np.array([1.0 if more else -1.0 for _, more in criteria])
    judged = np.array([strict is None or c in strict for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        x = np.stack([t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], axis=1) * sign
        known = ~np.isnan(x).any(axis=1)
        points, of = np.unique(x[known], axis=0, return_inverse=True)
        keep, front = np.zeros(len(points), bool), np.zeros((0, len(names)))
        for k in np.lexsort(-points.T[::-1]):
            p = points[k]
            if not (len(front) and ((front >= p).all(axis=1) & (front > p)[:, judged].any(axis=1)).any()):
                # With fewer strict criteria a later row may still dominate an earlier one; those go when they meet it.
                front = front[~((p >= front).all(axis=1) & (p > front)[:, judged].any(axis=1))]
                front = np.vstack([front, p])
        held = {tuple(p) for p in front}
        keep = np.array([tuple(p) in held for p in points], bool)
        stay = np.ones(len(x), bool)
        stay[known] = keep[of.ravel()] if len(points) else True
        yield from t.filter(pa.array(stay)).to_batches()

    out, parts = rows.mapInArrow(run, rows.schema), rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 16)
        out = checkpointed(out).repartition(parts).mapInArrow(run, rows.schema)
    return out

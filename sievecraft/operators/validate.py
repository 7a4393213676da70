"""Checks of answers, populations, leakage and recomputed metrics; each returns one row of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answers(rows: DataFrame, queries: DataFrame, valid: DataFrame, most: int = 5) -> DataFrame:
    per = rows.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    a = queries.join(per, "qid", "left").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > most).alias("too_many"), F.count_if(F.col("n") != F.col("d")).alias("repeated"))
    return a.crossJoin(rows.join(valid, "doc_id", "left_anti").agg(F.count("*").alias("unknown")))


def leakage(train: DataFrame, held: DataFrame) -> DataFrame:
    return train.join(held, "qid", "left_semi").agg(F.countDistinct("qid").alias("leaked"))


def recomputed(a: DataFrame, b: DataFrame, column: str, tolerance: float = 1e-12) -> DataFrame:
    j = a.select("qid", F.col(column).alias("x")).join(b.select("qid", F.col(column).alias("y")), "qid", "full")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("x") - F.col("y")) > tolerance)).alias("different"))


def membership(before: DataFrame, after: DataFrame) -> DataFrame:
    """queries, changed: whether two orders of the candidates hold the same documents for each query."""
    a, b = (x.groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias(n)) for x, n in ((before, "a"), (after, "b")))
    return a.join(b, "qid", "full").agg(F.count("*").alias("queries"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))


def manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """files, missing, added, changed: the (name, h) of a folder against those a manifest lists."""
    j = found.select("name", F.col("h").alias("a")).join(expected.select("name", F.col("h").alias("b")), "name", "full")
    return j.agg(F.count("*").alias("files"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def covers(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """missing, extra, repeated: whether the keys of ``rows`` cover those expected exactly once."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).join(expected.select(key).distinct().withColumn("e", F.lit(1)), key, "full")
    return n.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"))

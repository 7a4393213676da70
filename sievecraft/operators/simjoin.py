"""Exact similarity join of sparse vectors of unit length by prefix filtering.

Terms are ordered from the rarest to the most frequent. A vector's prefix ends where what is left of it is shorter than
the threshold: two vectors at least that similar share a term of both prefixes, for otherwise all they share lies in
the rest of one of them, whose product with a unit vector stays below the threshold. So vectors meet by rare terms, and
the terms that very many vectors hold hardly ever meet themselves. Pairs that even their sizes and largest weights keep
below the threshold are dropped, the others are verified on whole vectors.

Equal vectors are one class and join once, by its smallest id; a class of any size costs no pairs. Vectors that hold
frequent terms alone still meet by these; that is the exact result's price, and such a join is dealt by the skew
handling of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.session import checkpointed

SLACK = 1e-9  # below the threshold, for sums that end in other digits


def classes(vectors: DataFrame) -> DataFrame:
    """qid, rep: the smallest id among those of equal vectors (qid, term, weight)."""
    whole = vectors.groupBy("qid").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("term", F.round("weight", 12).alias("weight"))))), 256).alias("vector"))
    first = whole.groupBy("vector").agg(F.min("qid").alias("rep"))
    return whole.join(first, "vector").select("qid", "rep")


def candidates(vectors: DataFrame, least: float) -> DataFrame:
    """a, b (a < b): the pairs that share a term of their prefixes and may be ``least`` similar by size and largest weight."""
    df = vectors.groupBy("term").agg(F.count("*").alias("df"))
    frequent_first = W.partitionBy("qid").orderBy(F.desc("df"), F.desc("term")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("qid")
    ranked = vectors.join(df, "term").withColumn("left", F.sum(F.col("weight") * F.col("weight")).over(frequent_first))
    sized = ranked.withColumn("size", F.count("*").over(whole)).withColumn("top", F.max("weight").over(whole))
    prefix = checkpointed(sized.where(F.col("left") >= least * least - SLACK).select("qid", "term", "size", "top"))
    one, other = (prefix.select("term", *[F.col(c).alias(n) for c, n in zip(("qid", "size", "top"), names)]) for names in (("a", "size_a", "top_a"), ("b", "size_b", "top_b")))
    may = F.least("size_a", "size_b") * F.col("top_a") * F.col("top_b") >= least - SLACK
    return one.join(other, "term").where((F.col("a") < F.col("b")) & may).select("a", "b").distinct()


def similar_pairs(vectors: DataFrame, least: float, digits: int = 9) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, sim) of representatives at least ``least`` similar, a < b; and the classes (qid, rep). Vectors should be a written table."""
    of = checkpointed(classes(vectors))
    own = checkpointed(vectors.join(of.where(F.col("qid") == F.col("rep")).select("qid"), "qid", "left_semi"))
    met = candidates(own, least)
    a, b = (own.select(F.col("qid").alias(n), "term", F.col("weight").alias(f"w_{n}")) for n in ("a", "b"))
    sims = met.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.round(F.sum(F.col("w_a") * F.col("w_b")), digits).alias("sim"))
    return sims.where(F.col("sim") >= least), of


def nearest_similar(vectors: DataFrame, least: float, k: int, digits: int = 9) -> DataFrame:
    """qid, other, sim, rank: of each vector its ``k`` nearest others among those at least ``least`` similar; ties to the smaller id.

    Of a class its first k + 1 members are candidates, which is all that its members and neighbours can take.
    """
    links, of = similar_pairs(vectors, least, digits)
    links = checkpointed(links)
    place = F.row_number().over(W.partitionBy("rep").orderBy("qid"))
    first = of.withColumn("place", place).where(F.col("place") <= k + 1).select(F.col("rep").alias("near"), F.col("qid").alias("other"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    same = of.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("sim"))
    reach = both.unionByName(same).select(F.col("a").alias("rep"), F.col("b").alias("near"), "sim")
    near = of.join(reach, "rep").join(first, "near").where(F.col("qid") != F.col("other"))
    return near.select("qid", "other", "sim", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "other")).alias("rank")).where(F.col("rank") <= k)

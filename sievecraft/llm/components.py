"""Connected components of a link table by alternating star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.hot import join_per_key
from sievecraft.session import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point each node's larger (or smaller) neighbours at the least of its neighbourhood."""
    if large:
        around = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        around = links.select(F.col("v").alias("x"), F.col("u").alias("y"))
    around = checkpointed(around)
    least = checkpointed(around.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n"))
    moved = join_per_key(around, least, "x", "n", around.count())
    if large:
        moved = moved.where("y > x").select(F.col("m").alias("u"), F.col("y").alias("v"))
    else:
        moved = moved.select(F.col("m").alias("u"), F.col("y").alias("v")).unionByName(least.select(F.col("m").alias("u"), F.col("x").alias("v")))
    return moved.where("u < v").distinct()


def _print_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """node, root (least node of its component) for every node that has a link.

    ``links`` has integer columns u and v. Large-star and small-star steps alternate until the table no longer changes,
    which takes a logarithmic number of rounds; each round is written to the checkpoint folder, so a lost executor
    costs one round at most. Nothing but a count and a sum reaches the driver.
    """
    now = checkpointed(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    seen = _print_of(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = checkpointed(_star(_star(now, True), False))
        if (new := _print_of(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())

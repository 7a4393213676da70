"""Merkle manifest of a dataset: a digest of every row, a hash tree per source, one root, and each row's proof.

Levels are DataFrames. A level's nodes are numbered within their source (``row_number`` within range partitions, plus
the number of rows in the partitions before), their numbers divided by ``FANOUT`` name the parent, and the sorted child
arrays of a parent are hashed. Proofs are built from the top down over runs of siblings, not over rows: each level joins
its runs with the run that holds them one level up and appends the siblings found there, so keys meet at most
``FANOUT`` times, and a row joins nothing: it stands in the array of its own run. Every level is written to the
checkpoint folder.

H is lowercase hex sha256; a leaf is H of doc_id, source, lang, n_chars and text, each ``-`` if null, else its UTF-8
byte count, ``:`` and the value. ``folded_root`` is computed anew for every row from its leaf (or that of a tampered
row) and the siblings of its proof.

Defined results: rows with a null source form a source of their own, which comes first; rows with a null id come first
in their source and are never tampered with; rows of one id follow by leaf, so rows repeated in full may change places
without changing a digest; a lone leaf is its subroot, a lone subroot the root; the hash of an empty proof is that of
the empty string; an empty table gives an empty result; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.session import checkpointed

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def tampered_rows(doc_id: Column) -> Column:
    """Rows that the audit changes: crc32 of the decimal id is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, the place from 0 among the rows of the same ``g`` by ``order``, and ``n``, the number of these.

    A group may hold any share of the rows: it is cut into ranges, which are counted; there are no more counts than
    partitions and groups together.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = checkpointed(rows.repartitionByRange(parts, "g", *order)).withColumn("part", F.spark_partition_id())
    counts = ranged.groupBy("part", "g").agg(F.count("*").alias("here"))
    before = F.sum("here").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("part", "g", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(W.partitionBy("g")).alias("n"))
    local = ranged.withColumn("row", F.row_number().over(W.partitionBy("part", "g").orderBy(*order)))
    return local.join(counts, ["part", "g"]).withColumn("i", F.col("before") + F.col("row") - 1).drop("part", "row", "before")


def runs(nodes: DataFrame, *payload: str) -> DataFrame:
    """g, n, p, kids, digest: up to FANOUT consecutive nodes under their parent; a lone node is passed on unhashed."""
    kids = F.array_sort(F.collect_list(F.struct("i", "digest", *payload)))
    grouped = nodes.groupBy("g", "n", F.expr(f"i div {FANOUT}").alias("p")).agg(kids.alias("kids"))
    return grouped.withColumn("digest", F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(digest(F.array_join("kids.digest", ""))))


def tree(nodes: DataFrame, *payload: str) -> list[DataFrame]:
    """The runs of each level, leaves first; nodes has g, n, i, digest and the payload of the leaves."""
    levels = [checkpointed(runs(nodes, *payload))]
    most = levels[0].agg(F.max("n")).head()[0] or 0
    while most > FANOUT:
        most = -(-most // FANOUT)
        above = levels[-1].where(F.col("n") > FANOUT).select("g", F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.col("p").alias("i"), "digest")
        levels.append(checkpointed(runs(above)))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """g, digest: the single digest that each group ends in."""
    return reduce(DataFrame.unionByName, [x.where(F.col("n") <= FANOUT).select("g", "digest") for x in levels])


def siblings(digests: Column, at: Column) -> Column:
    """One step of a path: the digests of a run to the left and to the right of child ``at``."""
    return F.struct(F.array_join(F.slice(digests, F.lit(1), at), "").alias("l"), F.array_join(F.slice(digests, at + 2, F.lit(FANOUT)), "").alias("r"))


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaf runs with ``path`` (the steps from the run upwards) and the columns of ``above`` (g, path, more)."""
    carried = [c for c in above.columns if c not in ("g", "path")]
    here = None
    for level in reversed(levels):
        upper, here = here, level.where(F.col("n") <= FANOUT).join(above, "g")
        if upper is not None:
            upper = checkpointed(upper.select("g", F.col("p").alias("up"), F.col("kids.digest").alias("digests"), "path", *carried))
            held = level.where(F.col("n") > FANOUT).withColumn("up", F.expr(f"p div {FANOUT}")).join(upper, ["g", "up"])
            step = F.array(siblings(F.col("digests"), F.expr(f"cast(p % {FANOUT} as int)")))
            here = here.unionByName(held.withColumn("path", F.concat(step, "path")).select(*here.columns))
    return here


def rows_with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """One row per leaf: ``kid``, and its whole ``path``; and the columns of ``above``."""
    carried = [c for c in above.columns if c not in ("g", "path")]
    each = with_paths(levels, above).select("n", "kids", "path", *carried, F.posexplode("kids").alias("at", "kid"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(siblings(F.col("kids.digest"), F.col("at"))), "path"))
    return each.select("kid", path.alias("path"), *carried)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    own = [F.col(c) for c in FIELDS]
    leaf = digest(*map(framed, own))
    changed = F.when(tampered_rows(F.col("doc_id")), digest(*map(framed, own[:-1]), framed(lower_ascii(F.col("text")))))
    # A letter in front keeps the null source apart and first; the order of the others is that of their bytes.
    g = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    leaves = docs.select(g.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), changed.alias("changed"))
    levels = tree(numbered(leaves, ["doc_id", "digest"]), "doc_id", "changed")
    subroots = tops(levels).select(F.lit("").alias("g"), F.col("g").alias("source"), "digest")
    over = tree(numbered(subroots, ["source"]), "source")
    step = "array<struct<l:string,r:string>>"
    root = tops(over).select("g", F.array().cast(step).alias("path"), F.col("digest").alias("root"))
    sources = rows_with_paths(over, root).select(F.col("kid.source").alias("g"), "path", F.col("kid.digest").alias("subroot"), "root")
    rows = rows_with_paths(levels, checkpointed(sources))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), ""), 256)
    start = F.coalesce("kid.changed", "kid.digest")
    folded = F.aggregate("path", start, lambda acc, x: digest(x["l"], acc, x["r"]))
    out = rows.select(F.col("kid.doc_id").alias("doc_id"), F.col("kid.digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

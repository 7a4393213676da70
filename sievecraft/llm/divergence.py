"""Audit of how sources differ within a language: the terms that mark a source, and the distance of every two sources.

Texts are counted where they are read: a task adds up the terms of its rows by (lang, source) and hands on one row per
term, so what is shuffled is counts. A language keeps the terms that at least ``MIN_DOCS`` of its documents have. A
count gives the smoothed share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in whole numbers throughout.

Marking terms are found by upper bounds. The postings of a group fall into buckets by count; a bucket's bound is the
share of its largest count less the smallest share that any of its terms has in the whole language, and no term of the
bucket exceeds it. Buckets are evaluated best first, in batches of growing size; a group is done once the bounds of all
its unseen buckets lie strictly below its k-th value, so the rest of its postings is never evaluated.

Distances are sums over all kept terms, also those that neither source has. They follow from the postings: what a
source adds against another one's share of a missing term depends on its counts only, so it is summed over a histogram
of these; where both sources have the term, the join of the postings corrects it.

Defined results: null text, lang and source count as ''; rows repeated in full count as often as they occur, ids are
not read; groups without a kept term have distances and no terms; a source alone in its language has no pairs; an
empty table gives an empty result; other columns are not read, whatever they are called. Shares are exact as long as a
language's N + 5 V stays below 9 * 10^15.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.llm.batches import short_batches
from sievecraft.llm.hot import join_per_key
from sievecraft.session import checkpointed

#: ASCII letters and everything beyond ASCII; in UTF-8 the bytes of the latter are all above 0x7F.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS, TOP = 30, 50
#: Terms that a task holds before it hands its counts on.
HELD = 200_000
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term), added up; and a row with term '' per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def counted() -> pa.RecordBatch:
            rows = [(lang, source, term.decode("utf-8", "replace"), n, with_it[term]) for (lang, source), (times, with_it) in groups.items() for term, n in times.items()]
            rows += [(lang, source, "", 0, 0) for lang, source in groups]
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
                times, with_it = groups.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(TERM.findall(text.encode("utf-8", "replace").lower()))
                size -= len(times)
                times.update(own)
                with_it.update(own.keys())
                size += len(times)
                if size + len(groups) > held:
                    yield counted()
                    groups, size = {}, 0
        yield counted()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    parts = short_batches(docs).select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # Dealt by language and term, which serves the sums over a language's sources too; tasks have added up what they could.
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)); long division by three digits at a time, which no product overflows; null without terms."""
    below = F.nullif(total + 5 * kept, F.lit(0))
    div = lambda a, b: F.call_function("div", a, b)
    rest, out = count + 5, F.lit(1).cast("long")
    for scale in (1_000_000, 1_000, 1):
        out = out + div(rest * 1000, below) * scale
        rest = (rest * 1000) % below
    return out


def bucket(count: Column) -> Column:
    """Counts to 32 alone, then sixteen buckets for each doubling."""
    return F.when(count <= 32, count).otherwise(F.floor(16 * F.log2(count.cast("double")))).cast("int")


def tables(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, source, term, n, lang_n) of the kept terms, and groups (lang, source, total, terms, lang_total, kept)."""
    same = W.partitionBy("lang", "term")
    counts = term_counts(docs).withColumn("lang_n", F.sum("n").over(same)).withColumn("lang_docs", F.sum("docs").over(same))
    counts = checkpointed(counts.where((F.col("term") == "") | (F.col("lang_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n"))
    postings = counts.where("term <> ''")
    own = postings.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    lang = postings.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = counts.where("term = ''").select(*GROUP).join(own, GROUP, "left").join(lang, "lang", "left")
    return postings, checkpointed(groups.select(*GROUP, *map(zero, ("total", "terms", "lang_total", "kept"))))


def marking_terms(postings: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: of each group the k terms whose share exceeds the language's most."""
    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= k)
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    postings = postings.withColumn("bucket", bucket(F.col("n")))
    total = postings.count()
    sized = postings.groupBy(*GROUP, "bucket").agg(F.max("n").alias("n"), F.min("lang_n").alias("lang_n"), F.count("*").alias("terms_here"))
    bound = sized.join(groups, GROUP).select(*GROUP, "bucket", "terms_here", (p - q).alias("bound")).where("bound > 0")
    best_first = W.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket")
    before = F.coalesce(F.sum("terms_here").over(best_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    unseen = checkpointed(bound.withColumn("before", before))
    found, batch = None, k
    while True:
        # A batch ends with the bucket that brings the terms seen to its size; the first one may fill the k places.
        now = unseen.where(F.col("before") < batch).groupBy(*GROUP).agg(F.collect_set("bucket").alias("buckets"))
        chosen = checkpointed(groups.join(now, GROUP))
        hits = join_per_key(postings, chosen, GROUP, "terms", total).where(F.array_contains("buckets", F.col("bucket")))
        hits = hits.select(*GROUP, F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
        found = checkpointed(ranked(hits if found is None else hits.unionByName(found.drop("rank"))))
        kth = found.where(F.col("rank") == k).select(*GROUP, F.col("value").alias("kth"))
        left = unseen.where(F.col("before") >= batch).join(kth, GROUP, "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        unseen, batch = checkpointed(left.drop("kth")), 4 * batch
        if unseen.isEmpty():
            return found


def source_pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the distance of every two sources of a language, both ways."""
    side = lambda df, s: df.select("lang", *[F.col(c).alias(c + s) for c in df.columns if c != "lang"])
    none = groups.select(*GROUP, "kept", share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p0"))
    had = checkpointed(join_per_key(postings, groups, GROUP, "terms", postings.count()).select(*GROUP, "term", "n", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p0")))
    pairs = side(none, "_a").join(side(none, "_b"), "lang").where("source_a <> source_b")
    constant = pairs.select("lang", "source_a", "source_b", F.when(F.col("kept_a") == 0, 0).otherwise(F.col("kept_a") * F.abs(F.col("p0_a") - F.col("p0_b"))).alias("value"))
    histogram = had.groupBy(*GROUP, "p", "p0").agg(F.count("*").alias("m"))
    alone = side(histogram, "_a").join(side(none, "_b"), "lang").where("source_a <> source_b")
    alone = alone.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("m_a") * (F.abs(F.col("p_a") - F.col("p0_b")) - F.abs(F.col("p0_a") - F.col("p0_b")))).alias("value"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    terms = had.select(*GROUP, "term", "p", "p0")
    one, other = [terms.select("lang", "term", *[F.col(c).alias(c + s) for c in ("source", "p", "p0")]) for s in ("_a", "_b")]
    both = one.join(other, ["lang", "term"]).where("source_a < source_b").groupBy("lang", "source_a", "source_b")
    both = both.agg(F.sum(gap("p_a", "p_b") - gap("p_a", "p0_b") - gap("p0_a", "p_b") + gap("p0_a", "p0_b")).alias("value"))
    swapped = lambda df: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value")
    parts = constant.unionByName(alone).unionByName(swapped(alone)).unionByName(both).unionByName(swapped(both))
    out = parts.groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("value").alias("value"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, k: int = TOP, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    postings, groups = tables(docs, min_docs)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pair = source_pairs(postings, groups).withColumn("part", F.lit("pair")).select(*columns)
    return pair.unionByName(marking_terms(postings, groups, k).withColumn("part", F.lit("term")).select(*columns))

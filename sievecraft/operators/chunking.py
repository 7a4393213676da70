"""Row generators: token windows, evenly spread windows, best passages of a document for a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions import text as X


def token_windows(docs: DataFrame, size: int = 500, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_no, chunk: windows that stop once one reaches the end; an empty document has one empty window."""
    t = docs.select("doc_id", X.tokens(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(size - overlap))
    return t.select("doc_id", "w", F.posexplode(starts).alias("chunk_no", "s")).select("doc_id", "chunk_no", F.slice("w", F.col("s") + 1, size).alias("words"))


def spread_windows(docs: DataFrame, window: int = 220, step: int = 150, cap: int = 16) -> DataFrame:
    """doc_id, start, words: at most ``cap`` windows, spread evenly over all starts (rounded half to even)."""
    t = docs.select("doc_id", X.space_words(F.col("text")).alias("w"))
    n = F.floor((F.greatest(F.size("w") - (window - step), F.lit(1)) - 1) / step).cast("int") + 1
    t = t.withColumn("n", n)
    at = F.when(F.col("n") <= cap, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(cap - 1)).cast("int"))))
    return t.select("doc_id", "w", F.explode(at).alias("k")).select("doc_id", (F.col("k") * step).alias("start"), F.slice("w", F.col("k") * step + 1, window).alias("words"))


#: Words of a document that go before a passage, and the line between.
HEADER_WORDS, HEADER_MARK = 70, "\n[ĐOẠN PHÙ HỢP]\n"


def top_passages(pairs: DataFrame, count: int = 2, window: int = 220, overlap: int = 70) -> DataFrame:
    """qid, doc_id, rank, start, density, passage: the best windows of each (question, text) pair.

    A text of ``window`` + 80 words or fewer is one passage. Else a window scores 1 + 0.2 min(tf, 3) for each content
    word of the question that it holds, 3 for each word of it with a digit, 1.8 for each of its bigrams that occurs in
    the window's text; windows are ordered by score per root of their length, by score, and by start. A passage that
    does not hold the document's first words is preceded by them.
    """
    step, none = window - overlap, F.array().cast("array<string>")
    q = pairs.select("qid", "doc_id", X.tokens(F.col("question")).alias("q"), X.space_words(F.col("text")).alias("w"))
    stop = F.array(*map(F.lit, X.PASSAGE_STOP_WORDS))
    q = q.withColumn("content", F.array_distinct(F.filter("q", lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)))).withColumn("numbers", F.array_distinct(F.filter("q", lambda t: t.rlike(r"\p{Nd}")))).withColumn("big", F.array_distinct(X.windows(F.col("q"), 2)))
    n = F.size("w")
    whole = n <= window + 80
    starts = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - window) / step) * step).cast("int"), F.lit(step)))
    win = q.withColumn("whole", whole).select("*", F.explode(starts).alias("start")).withColumn("part", F.array_join(F.when(F.col("whole"), F.col("w")).otherwise(F.slice("w", F.col("start") + 1, window)), " "))
    win = win.withColumn("c", X.tokens(F.col("part"))).withColumn("joined", F.array_join("c", " "))
    # The window is cut to the question's words first, so that counting looks at these alone.
    win = win.withColumn("hits", F.filter("c", lambda x: F.array_contains(F.col("q"), x)))
    tf = lambda t: F.size(F.filter("hits", lambda x: x == t))
    cover = F.aggregate(F.transform("content", lambda t: F.when(F.array_contains("hits", t), 1 + 0.2 * F.least(tf(t), F.lit(3))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    total = cover + 3.0 * F.size(F.array_intersect("numbers", F.coalesce("hits", none))) + 1.8 * F.size(F.filter("big", lambda g: F.contains("joined", g)))
    scored = win.withColumn("total", F.round(total, 9)).withColumn("density", F.round(F.col("total") / F.sqrt(F.greatest(F.size("c"), F.lit(1))), 9))
    header = F.concat(F.array_join(F.slice("w", 1, HEADER_WORDS), " "), F.lit(HEADER_MARK))
    passage = F.when(F.col("whole") | (F.col("start") < HEADER_WORDS), F.col("part")).otherwise(F.concat(header, F.col("part")))
    best = scored.withColumn("passage", passage).groupBy("qid", "doc_id", "passage").agg(F.min(F.struct((-F.col("density")).alias("d"), (-F.col("total")).alias("t"), "start")).alias("o"))
    r = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy("o"))
    return best.withColumn("rank", r).where(F.col("rank") <= count).select("qid", "doc_id", "rank", F.col("o.start").alias("start"), (-F.col("o.d")).alias("density"), "passage")


def chosen_evidence(pairs: DataFrame, first: DataFrame, second: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, doc_id, chunk_id, selector: a pair's best chunk of the first ranking, else of the second, else the document's first."""
    lead = chunks.groupBy("doc_id").agg(F.min("chunk_id").alias("c3"))
    j = pairs.select("qid", "doc_id").join(first.select("qid", "doc_id", F.col("chunk_id").alias("c1")), ["qid", "doc_id"], "left").join(second.select("qid", "doc_id", F.col("chunk_id").alias("c2")), ["qid", "doc_id"], "left").join(lead, "doc_id", "left")
    how = F.when(F.col("c1").isNotNull(), "first").when(F.col("c2").isNotNull(), "second").when(F.col("c3").isNotNull(), "lead").otherwise("missing")
    return j.select("qid", "doc_id", F.coalesce("c1", "c2", "c3").alias("chunk_id"), how.alias("selector"))


def rerank_windows(pairs: DataFrame, most: int = 1024, most_query: int = 512, overlap: int = 80, special: int = 2) -> DataFrame:
    """qid, doc_id, window, start, question (words), words: what a reranker reads of each (question, text) pair.

    A question is cut to ``most_query`` words. What it and ``special`` marks leave of ``most`` is the width of a window;
    windows overlap by ``overlap`` words or a quarter of the width, whichever is less, and the last one is moved back
    so that it ends with the text and is as wide as the others. A text that fits is one window, an empty one too.
    Raises if a question leaves no room.
    """
    t = pairs.select("qid", "doc_id", F.slice(X.space_words(F.col("question")), 1, most_query).alias("question"), X.space_words(F.col("text")).alias("w"))
    t = t.withColumn("width", most - F.size("question") - special)
    t = t.withColumn("width", F.when(F.col("width") < 1, F.raise_error(F.lit("a question leaves no room for a text"))).otherwise(F.col("width")))
    n, width = F.size("w"), F.col("width")
    step = F.greatest(width - F.least(F.lit(overlap), F.floor(width / 4).cast("int")), F.lit(1))
    # Windows start a step apart; the first that reaches the end is the last.
    count = F.when(n <= width, 1).otherwise(F.ceil((n - width) / step).cast("int") + 1)
    each = t.withColumn("step", step).withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    start = F.greatest(F.least(F.col("window") * F.col("step"), F.col("n") - F.col("width")), F.lit(0))
    return each.withColumn("start", start).select("qid", "doc_id", "window", "start", "question", F.slice("w", F.col("start") + 1, F.col("width")).alias("words"))


def merged_windows(scored: DataFrame) -> DataFrame:
    """qid, doc_id, score, rank: the best window's score (0 at least) of each pair, and its place in the question."""
    best = scored.groupBy("qid", "doc_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))

"""Per-query window features, posteriors of labelled questions, and rows for rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def z_gap(scores: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """z and gap to the top of a nullable score; a missing score is the mean less two deviations, a zero deviation 1."""
    q = W.partitionBy(*by)
    mean, sd = F.coalesce(F.avg("score").over(q), F.lit(0.0)), F.coalesce(F.nullif(F.stddev_pop("score").over(q), F.lit(0.0)), F.lit(1.0))
    top = F.coalesce(F.max("score").over(q), F.lit(0.0))
    filled = F.coalesce("score", mean - 2 * sd)
    return scores.select(*by, "doc_id", ((filled - mean) / sd).alias("z"), (filled - top).alias("gap"))


def rank_features(ranks: DataFrame, branches: tuple[str, ...], missing: int = 60) -> DataFrame:
    """1/(10 + r) per view, least and mean rank over all views."""
    p = ranks.groupBy("qid", "doc_id").pivot("branch", list(branches)).agg(F.min("rank"))
    r = [F.coalesce(F.col(b), F.lit(missing)) for b in branches]
    return p.select("qid", "doc_id", *[(1 / (10 + x)).alias(f"rr_{b}") for b, x in zip(branches, r)], F.least(*r).alias("least_rank"), (sum(r, F.lit(0)) / len(r)).alias("mean_rank"))


def type_share(pool: DataFrame) -> DataFrame:
    return pool.select("qid", "doc_id", "kind", (F.count("*").over(W.partitionBy("qid", "kind")) / F.count("*").over(W.partitionBy("qid"))).alias("share"))


def threshold(ranked: DataFrame, alpha: float = 0.15, most: int = 5) -> DataFrame:
    """Keep rank 1, and ranks up to ``most`` whose score is at least alpha of the first."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(W.partitionBy("qid"))
    return ranked.withColumn("first", first).where((F.col("rank") == 1) | ((F.col("rank") <= most) & (F.col("score") >= alpha * F.col("first")))).drop("first")


def band_negatives(run: DataFrame, gold: DataFrame, n: int, low: int = 4, high: int = 20) -> DataFrame:
    """n documents per query that are no answer: the band first, then the others by rank."""
    other = run.join(gold, ["qid", "doc_id"], "left_anti")
    r = F.row_number().over(W.partitionBy("qid").orderBy(F.when(F.col("rank").between(low, high), 0).otherwise(1), "rank", "doc_id"))
    return other.withColumn("pick", r).where(F.col("pick") <= n).select("qid", "doc_id", "pick")


def query_weights(rows: DataFrame, scheme: str = "halves") -> DataFrame:
    """The weight of each row within its query.

    ``halves``: half of a query's weight on its answers, half on the rest; ``equal``: one over its rows; ``balanced``: as
    halves but with a mean of one, and 1 for each row of a query that has no answer.
    """
    q = W.partitionBy("qid")
    pos, n = F.sum("y").over(q), F.count("*").over(q)
    halves = F.when(F.col("y") == 1, 0.5 / pos).when(pos < n, 0.5 / (n - pos)).otherwise(0.0)
    return rows.withColumn("weight", {"halves": halves, "equal": 1.0 / n, "balanced": F.when(pos == 0, 1.0).otherwise(n * halves)}[scheme])


def branch_features(runs: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """Reciprocal rank, score relative to the list's top, presence; sums and maxima over the branches."""
    rel = F.col("score") / F.nullif(F.greatest(F.max("score").over(W.partitionBy("qid", "branch")), F.lit(0.0)), F.lit(0.0))
    r = runs.withColumn("rel", F.coalesce(rel, F.lit(0.0)))
    at = lambda b, x: F.coalesce(F.max(F.when(F.col("branch") == b, x)), F.lit(0.0))
    p = r.groupBy("qid", "doc_id").agg(*[at(b, 1 / (10 + F.col("rank"))).alias(f"rr_{b}") for b in branches], *[at(b, F.col("rel")).alias(f"rel_{b}") for b in branches], F.count("*").alias("present"))
    rr, rel_ = [F.col(f"rr_{b}") for b in branches], [F.col(f"rel_{b}") for b in branches]
    return p.withColumn("rr_sum", sum(rr, F.lit(0.0))).withColumn("rr_max", F.greatest(*rr)).withColumn("rel_sum", sum(rel_, F.lit(0.0))).withColumn("rel_max", F.greatest(*rel_))


def label_prior(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """Log-frequency of a document among the answers of other queries (own answers are taken out), unseen and rare flags."""
    freq = gold.groupBy("doc_id").agg(F.count("*").alias("f"))
    own = gold.select("qid", "doc_id", F.lit(1).alias("own"))
    n = F.coalesce("f", F.lit(0)) - F.coalesce("own", F.lit(0))
    j = pool.select("qid", "doc_id").join(freq, "doc_id", "left").join(own, ["qid", "doc_id"], "left").withColumn("n", n)
    return j.select("qid", "doc_id", F.log1p("n").alias("prior"), (F.col("n") == 0).cast("int").alias("unseen"), F.col("n").between(1, 2).cast("int").alias("rare"))


def profile_scores(asked: DataFrame, support: DataFrame, power: float = 0.5) -> DataFrame:
    """qid, doc_id, score: BM25 of a query's features over document profiles, the features of the questions they answer.

    ``asked`` has (qid, feature); ``support`` has (qid, doc_id, feature) of labelled questions to learn from.
    """
    tf = support.groupBy("doc_id", "feature").agg(F.count("*").alias("tf"))
    dl = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    lf = support.groupBy("doc_id").agg(F.countDistinct("qid").alias("lf"))
    stats = dl.join(lf, "doc_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.max("lf").alias("top"))
    t = tf.join(tf.groupBy("feature").agg(F.count("*").alias("df")), "feature").join(asked.select("feature").distinct(), "feature", "left_semi").join(dl, "doc_id").join(lf, "doc_id").crossJoin(F.broadcast(stats))
    weight = F.when(F.col("feature").startswith("3:"), 1.65).when(F.col("feature").startswith("2:"), 1.35).otherwise(1.0)
    part = weight * F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    prior = F.pow((F.col("lf") + 0.5) / (F.col("top") + 0.5), F.lit(power))
    return asked.join(t.select("doc_id", "feature", (part * prior).alias("part")), "feature").groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))


def evidence_top3(votes: DataFrame, power: float = 1.0) -> DataFrame:
    """qid, doc_id, score: the three strongest similarities count 1, 0.40, 0.15."""
    rn = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.desc("sim"), "other"))
    v = F.pow("sim", F.lit(power))
    return votes.withColumn("rn", rn).where("rn <= 3").groupBy("qid", "doc_id").agg(F.sum(F.when(F.col("rn") == 1, v).when(F.col("rn") == 2, 0.4 * v).otherwise(0.15 * v)).alias("score"))


def posterior(a: DataFrame, b: DataFrame, mix: float = 0.5, prior: DataFrame | None = None, power: float = 0.0) -> DataFrame:
    """Mixture of two evidence channels, each over its own maximum in a query.

    With ``prior`` (doc_id, n: questions that it answers) a document's score is multiplied by ((n + 0.5) / (largest n +
    0.5)) to the ``power``, n being 0 for documents that are not in it.
    """
    j = a.select("qid", "doc_id", F.col("score").alias("sa")).join(b.select("qid", "doc_id", F.col("score").alias("sb")), ["qid", "doc_id"], "full")
    q = W.partitionBy("qid")
    n = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(q), F.lit(0.0)), F.lit(0.0))
    mixed = j.select("qid", "doc_id", (mix * n("sa") + (1 - mix) * n("sb")).alias("score"))
    if prior is None:
        return mixed
    top = prior.agg(F.coalesce(F.max("n"), F.lit(1)).alias("top"))
    known = mixed.join(prior.select("doc_id", "n"), "doc_id", "left").crossJoin(F.broadcast(top))  # one row
    return known.select("qid", "doc_id", (F.col("score") * F.pow((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("top") + 0.5), F.lit(float(power)))).alias("score"))


def confidence(scores: DataFrame, depth: int = 20) -> DataFrame:
    """Top score, margin to the second, normalised entropy of the first ``depth``."""
    r = scores.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).where((F.col("rank") <= depth) & (F.col("score") > 0))
    p = r.withColumn("p", F.col("score") / F.sum("score").over(W.partitionBy("qid")))
    top, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0))
    return p.groupBy("qid").agg(top.alias("top"), (top - second).alias("margin"), F.coalesce(-F.sum(F.col("p") * F.log("p")) / F.nullif(F.log(F.count("*").cast("double")), F.lit(0.0)), F.lit(0.0)).alias("entropy"))


def pair_differences(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """qid, pos, neg and the difference of each column for every (answer, other) pair of a query."""
    p = rows.where("y = 1").select("qid", F.col("doc_id").alias("pos"), *[F.col(c).alias(f"p_{c}") for c in columns])
    n = rows.where("y = 0").select("qid", F.col("doc_id").alias("neg"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return p.join(n, "qid").select("qid", "pos", "neg", *[(F.col(f"p_{c}") - F.col(f"n_{c}")).alias(c) for c in columns])


def sharing_words(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """qid, doc_id, q, t of the pairs whose word arrays q and t share a word, by a join on words; others have overlap 0."""
    words = queries.select("qid", F.explode("q").alias("w")).join(titles.select("doc_id", F.explode("t").alias("w")), "w").select("qid", "doc_id").distinct()
    return words.join(queries, "qid").join(titles, "doc_id")


def title_overlap(pairs: DataFrame) -> DataFrame:
    """Jaccard and recalls of two word arrays q and t."""
    i, u = F.size(F.array_intersect("q", "t")), F.size(F.array_union("q", "t"))
    return pairs.select("qid", "doc_id", (F.size("t") > 0).cast("int").alias("has_title"), F.coalesce(i / F.nullif(u, F.lit(0)), F.lit(0.0)).alias("jaccard"), F.coalesce(i / F.nullif(F.size("q"), F.lit(0)), F.lit(0.0)).alias("recall_q"), F.coalesce(i / F.nullif(F.size("t"), F.lit(0)), F.lit(0.0)).alias("recall_t"))

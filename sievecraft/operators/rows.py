"""Rows of features for rankers: branches, label priors, lexical coverage, document classes, fused views, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import features, fuse

def _q():
    return W.partitionBy("qid")


#: Weights of the four branches in the base fusion, its constant, and the temperatures of its ranks.
BASE_WEIGHTS, BASE_K = (0.063, 0.357, 0.28, 0.30), 5
TEMPERATURES = (0, 2, 5, 10, 20, 40, 80)


def _flag(c: Column) -> Column:
    return c.cast("double")


def score_rows(runs: DataFrame, branches: tuple[str, ...], most: int = 150) -> DataFrame:
    """qid, doc_id and 23 features of four branches, for the documents among the first ``most`` of any branch.

    rr 1/(5 + rank), sc the score over its list's largest, here whether it is listed; the number of lists, sums and
    maxima, and products of the second, third and fourth branch.
    """
    top = F.max("score").over(W.partitionBy("qid", "branch"))
    r = runs.where(F.col("branch").isin(*branches)).withColumn("sc", F.when(top > 0, F.col("score") / top).otherwise(0.0))
    at = lambda b, x: F.coalesce(F.max(F.when(F.col("branch") == b, x)), F.lit(0.0))
    p = r.groupBy("qid", "doc_id").agg(
        F.min("rank").alias("best"),
        *[at(b, 1 / (5 + F.col("rank"))).alias(f"rr{k}") for k, b in enumerate(branches)],
        *[at(b, F.col("sc")).alias(f"sc{k}") for k, b in enumerate(branches)],
        *[at(b, F.lit(1.0)).alias(f"here{k}") for k, b in enumerate(branches)],
    ).where(F.col("best") <= most)
    rr, sc, here = ([F.col(f"{x}{k}") for k in range(len(branches))] for x in ("rr", "sc", "here"))
    pairs = ((1, 2), (2, 3), (1, 3))
    return p.select(
        "qid", "doc_id", *rr, *sc, *here, sum(here[1:], here[0]).alias("lists"), sum(rr[1:], rr[0]).alias("rr_sum"), sum(sc[1:], sc[0]).alias("sc_sum"), F.greatest(*rr).alias("rr_max"), F.greatest(*sc).alias("sc_max"),
        *[(here[a] * here[b]).alias(f"here{a}{b}") for a, b in pairs], *[(sc[a] * sc[b]).alias(f"sc{a}{b}") for a, b in pairs],
    )


def label_rows(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """21 more features from how often a document is an answer to other queries (the query's own label is taken out)."""
    freq = gold.groupBy("doc_id").agg(F.count("*").alias("f"))
    own = gold.select("qid", "doc_id").distinct().withColumn("own", F.lit(1))
    n = F.greatest(F.coalesce("f", F.lit(0)) - F.coalesce("own", F.lit(0)), F.lit(0))
    j = rows.join(freq, "doc_id", "left").join(own, ["qid", "doc_id"], "left").withColumn("n", n)
    j = j.withColumn("prior", F.log1p("n") / F.greatest(F.max(F.log1p("n")).over(_q()), F.lit(1.0)))
    j = j.withColumn("unseen", _flag(F.col("n") == 0)).withColumn("rare", _flag(F.col("n") <= 1))
    support = F.col("here0") + F.col("here1") + F.col("here2")
    j = j.withColumn("lex_rr", F.col("rr0") + F.col("rr1") + F.col("rr2")).withColumn("lex_sc", F.col("sc0") + F.col("sc1") + F.col("sc2")).withColumn("best_lex", F.greatest("sc0", "sc1", "sc2"))
    j = j.withColumn("lex_support", support / 3).withColumn("two", _flag(support >= 2)).withColumn("three", _flag(support >= 3)).withColumn("sc_less_memory", F.col("lex_sc") - F.col("sc3")).withColumn("rr_less_memory", F.col("lex_rr") - F.col("rr3"))
    made = {
        "mem_rr": F.col("rr3"), "mem_sc": F.col("sc3"), "cold_two": F.col("unseen") * F.col("two"), "prior_mem_sc": F.col("prior") * F.col("sc3"), "prior_mem_rr": F.col("prior") * F.col("rr3"), "unseen_lex_sc": F.col("unseen") * F.col("lex_sc"),
        "unseen_lex_rr": F.col("unseen") * F.col("lex_rr"), "unseen_best": F.col("unseen") * F.col("best_lex"), "two_best": F.col("two") * F.col("best_lex"), "two_less": F.col("two") * F.col("sc_less_memory"),
    }
    return j.withColumns(made).drop("f", "own", "n")


def base_rank(runs: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """qid, doc_id, rank of the fixed four-branch fusion."""
    return fuse.rrf(runs, dict(zip(branches, BASE_WEIGHTS)), BASE_K).select("qid", "doc_id", "rank")


def temperature_rows(rows: DataFrame, ranking: DataFrame, missing: int = 100_000) -> DataFrame:
    """Adds 1/(k + rank in ``ranking``) for each temperature k."""
    j = rows.join(ranking.select("qid", "doc_id", F.col("rank").alias("base_rank")), ["qid", "doc_id"], "left")
    return j.withColumns({f"t{k}": 1 / (k + F.coalesce("base_rank", F.lit(missing))) for k in TEMPERATURES}).drop("base_rank")


def lexical_rows(pairs: DataFrame, eligible: Column | None = None) -> DataFrame:
    """qid, doc_id and 10 features of how a document covers a question; ``pairs`` has qid, doc_id, question and text.

    Words, content words (3 letters or more, no stop words), numbers, bigrams, trigrams and legal references of the
    question that stand in the normalised document; and its length. Where ``eligible`` is false all but the length are 0.
    """
    t = pairs.select("qid", "doc_id", X.tokens(F.col("question")).alias("q"), X.tokens(F.col("text")).alias("w"), X.legal_references(F.col("question")).alias("cites"), (F.lit(True) if eligible is None else eligible).alias("ok"))
    t = t.withColumn("doc", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))).withColumn("words", F.array_distinct("q"))
    t = t.withColumn("bi", F.array_distinct(X.windows(F.col("q"), 2))).withColumn("tri", F.array_distinct(X.windows(F.col("q"), 3)))
    stop = F.array(*map(F.lit, X.LEGAL_STOP_WORDS))
    t = t.withColumn("content", F.filter("words", lambda x: (F.length(x) >= 3) & ~F.array_contains(stop, x))).withColumn("numbers", F.filter("words", lambda x: x.rlike(r"\p{Nd}"))).withColumn("held", F.array_distinct("w"))
    padded = lambda c: F.size(F.filter(c, lambda x: F.contains(F.col("doc"), F.concat(F.lit(" "), x, F.lit(" ")))))
    share = lambda n, c: F.when(F.size(c) > 0, n / F.size(c)).otherwise(0.0)
    t = t.withColumn("n_num", F.size(F.array_intersect("numbers", "held"))).withColumn("n_tri", padded("tri")).withColumn("n_cite", F.size(F.filter("cites", lambda x: F.contains(F.col("doc"), x))))
    made = {
        "cover": share(F.size(F.array_intersect("words", "held")), "words"), "cover_content": share(F.size(F.array_intersect("content", "held")), "content"), "cover_numbers": share(F.col("n_num"), "numbers"),
        "all_numbers": _flag((F.size("numbers") > 0) & (F.col("n_num") == F.size("numbers"))), "cover_bi": share(padded("bi"), "bi"), "cover_tri": share(F.col("n_tri"), "tri"), "any_tri": _flag(F.col("n_tri") > 0),
        "cover_cites": share(F.col("n_cite"), "cites"), "all_cites": _flag((F.size("cites") > 0) & (F.col("n_cite") == F.size("cites"))),
    }
    return t.select("qid", "doc_id", *[F.when(F.col("ok"), c).otherwise(0.0).alias(k) for k, c in made.items()], (F.log1p(F.length("doc").cast("double")) / 15).alias("doc_length"))


def lexical_interactions(rows: DataFrame) -> DataFrame:
    """Adds the products of coverages with the scores of the branches: full, local, phrase, memory."""
    return rows.withColumns({"content_full": F.col("cover_content") * F.col("sc0"), "content_local": F.col("cover_content") * F.col("sc1"), "tri_phrase": F.col("cover_tri") * F.col("sc2"), "numbers_memory": F.col("cover_numbers") * F.col("sc3")})


def class_rows(pool: DataFrame, classes: DataFrame, hints: DataFrame) -> DataFrame:
    """12 features: the document's class (one of six), the share of the class in the query's pool, five hints of the question."""
    j = pool.select("qid", "doc_id").join(classes, "doc_id").join(hints, "qid")
    share = F.count("*").over(W.partitionBy("qid", "kind")) / F.count("*").over(_q())
    return j.select("qid", "doc_id", *[_flag(F.col("kind") == k).alias(f"is_{k.lower()}") for k in X.DOC_CLASSES], share.alias("share"), *[F.col(c) for c in hints.columns if c != "qid"])


def fused_rows(pool: DataFrame, ranks: DataFrame, views: tuple[str, ...], channels: DataFrame, names: tuple[str, ...], missing: int = 60) -> DataFrame:
    """2V + 2 + 2S features: 1/(10 + rank) and rank/60 in each view, least and mean rank, z and gap of each channel.

    ``ranks`` and ``channels`` are long tables (branch, rank) and (branch, score); channels come in alphabetical order.
    A gap is in standard deviations; a missing score is the mean less two of them.
    """
    out = pool.select("qid", "doc_id")
    if views:
        p = ranks.where(F.col("branch").isin(*views)).groupBy("qid", "doc_id").pivot("branch", list(views)).agg(F.min("rank"))
        r = [F.coalesce(F.col(f"`{v}`"), F.lit(missing)) for v in views]
        out = out.join(p, ["qid", "doc_id"], "left").select("qid", "doc_id", *[(1 / (10 + x)).alias(f"rr_{v}") for v, x in zip(views, r)], *[(x / missing).alias(f"r_{v}") for v, x in zip(views, r)], (F.least(*r) if len(r) > 1 else r[0]).alias("least_rank"), (sum(r[1:], r[0]) / len(r)).alias("mean_rank"))
    if not names:
        return out
    s = channels.where(F.col("branch").isin(*names)).groupBy("qid", "doc_id").pivot("branch", list(names)).agg(F.max("score"))
    out = out.join(s, ["qid", "doc_id"], "left")
    made = {}
    for c in sorted(names):
        mean, sd = F.coalesce(F.avg(c).over(_q()), F.lit(0.0)), F.coalesce(F.nullif(F.stddev_pop(c).over(_q()), F.lit(0.0)), F.lit(1.0))
        filled = F.coalesce(F.col(c), mean - 2 * sd)
        made |= {f"z_{c}": (filled - mean) / sd, f"gap_{c}": (filled - F.coalesce(F.max(c).over(_q()), F.lit(0.0))) / sd}
    return out.withColumns(made).drop(*names)


def configured_rows(config: dict, pool: DataFrame, ranks: DataFrame, channels: DataFrame, metadata: dict[str, DataFrame], missing: int = 60) -> DataFrame:
    """qid, doc_id and the features that ``config`` names, in this order: rank_views, score_channels, metadata.

    Views give their two columns each and the least and mean rank, channels z and gap; a metadata table (doc_id, or qid
    and doc_id) gives its columns, 0 where it has no row. Raises if nothing is named, or something unknown.
    """
    views, names, meta = (tuple(config.get(k, ())) for k in ("rank_views", "score_channels", "metadata"))
    if not (views or names or meta):
        raise ValueError("empty feature configuration")
    if unknown := [m for m in meta if m not in metadata]:
        raise ValueError(f"no metadata of the name {', '.join(unknown)}")
    made = fused_rows(pool, ranks, views, channels, names, missing)
    for m in meta:
        t = metadata[m]
        keys = [k for k in ("qid", "doc_id") if k in t.columns]
        own = {c: f"{m}_{c}" for c in t.columns if c not in keys}
        made = made.join(t.withColumnsRenamed(own), keys, "left").fillna(0, list(own.values()))
    order = [f"{p}_{v}" for v in views for p in ("rr", "r")] + (["least_rank", "mean_rank"] if views else []) + [f"{p}_{c}" for c in names for p in ("z", "gap")]
    return made.select("qid", "doc_id", *order, *[c for c in made.columns if c not in order and c not in ("qid", "doc_id")])


def similarity_rows(rows: DataFrame) -> DataFrame:
    """z, gap and presence of a nullable similarity (as of titles); a missing one is two deviations below the mean."""
    z = features.z_gap(rows.withColumnRenamed("sim", "score"))
    return z.join(rows.select("qid", "doc_id", F.col("sim").isNotNull().cast("double").alias("has")), ["qid", "doc_id"])


def boundary_margin(run: DataFrame, at: int = 5) -> DataFrame:
    """qid, margin: the score at rank ``at`` less the next one, for queries that have both."""
    score = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return run.where(F.col("rank").between(at, at + 1)).groupBy("qid").agg((score(at) - score(at + 1)).alias("margin")).where("margin is not null")


def actions(run: DataFrame, columns: tuple[str, ...], at: int = 5, last: int = 20) -> DataFrame:
    """A row for each challenger (rank ``at`` + 1 .. ``last``) of a query's incumbent at rank ``at``.

    The columns of both and their differences, the difference of scores, the boundary margin, both ranks over ``last``.
    """
    old = run.where(F.col("rank") == at).select("qid", F.col("doc_id").alias("incumbent"), F.col("score").alias("old_score"), F.col("rank").alias("old_rank"), *[F.col(c).alias(f"i_{c}") for c in columns])
    new = run.where(F.col("rank").between(at + 1, last)).select("qid", F.col("doc_id").alias("challenger"), "score", "rank", *[F.col(c).alias(f"c_{c}") for c in columns])
    j = new.join(old, "qid").join(boundary_margin(run, at), "qid")
    both = [x for c in columns for x in (F.col(f"c_{c}"), F.col(f"i_{c}"), (F.col(f"c_{c}") - F.col(f"i_{c}")).alias(f"d_{c}"))]
    return j.select("qid", "challenger", "incumbent", *both, (F.col("score") - F.col("old_score")).alias("score_less"), "margin", (F.col("old_rank") / last).alias("old_rank"), (F.col("rank") / last).alias("new_rank"))


def mirrored_pairs(rows: DataFrame, ranking: DataFrame, columns: tuple[str, ...], negatives: int = 40, depth: int = 100) -> DataFrame:
    """qid, pos, neg, y and the differences of each (answer, hard other) pair, and once more mirrored with y = 0.

    The others are the first ``negatives`` among the ``depth`` best of ``ranking`` that are no answers.
    """
    named = rows.join(ranking.select("qid", "doc_id", F.col("rank").alias("at")), ["qid", "doc_id"], "left")
    hard = named.where((F.col("y") == 0) & (F.col("at") <= depth)).withColumn("pick", F.row_number().over(_q().orderBy("at", "doc_id"))).where(F.col("pick") <= negatives)
    pairs = features.pair_differences(named.where("y = 1").unionByName(hard.drop("pick")), columns)
    return pairs.withColumn("y", F.lit(1)).unionByName(pairs.withColumns({c: -F.col(c) for c in columns}).withColumn("y", F.lit(0)))


def training_pool(lists: DataFrame, gold: DataFrame, negatives: int = 48) -> DataFrame:
    """qid, doc_id, y, pick: a query's answers and the first ``negatives`` others of its pool; queries lacking either go."""
    first = lists.groupBy("qid", "doc_id").agg(F.min(F.struct("rank", "branch")).alias("o")).join(gold.select("qid", "doc_id").distinct().withColumn("y", F.lit(1)), ["qid", "doc_id"], "left").where("y is null")
    other = first.select("qid", "doc_id", F.lit(0).alias("y"), F.row_number().over(_q().orderBy("o", "doc_id")).alias("pick")).where(F.col("pick") <= negatives)
    own = gold.select("qid", "doc_id").distinct().select("qid", "doc_id", F.lit(1).alias("y"), F.row_number().over(_q().orderBy("doc_id")).alias("pick"))
    return own.join(other.select("qid").distinct(), "qid", "left_semi").unionByName(other.join(own.select("qid").distinct(), "qid", "left_semi"))

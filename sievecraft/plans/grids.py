"""Queries of posterior sweeps, with the SQL of a part of the graph's grid."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import grids, retrieve, sets
from sievecraft.plans.registry import EDGES, RUNS, _STRENGTH, gold, memory_gold, neighbours, one, query
from sievecraft.session import checkpointed, table

#: A part of the graph's grid that SQL can go through one configuration after another.
SMALL = {"seeds": (1, 5), "power": (0.5, 2.0), "mode": ("conditional", "cosine", "jaccard", "lift"), "min_edge": (1, 2), "alpha": (0.1, 1.5), "base_k": (0, 20)}


def _graph(s, d, grid):
    g = gold(s, d)
    return grids.graph_grid(one(s, d, "view"), sets.cooccurrence(g), g.groupBy("doc_id").agg(F.count("*").alias("n")), g, grid)


@query()
def ml_graph_grid(s, d):
    """The thirty best of 13,824 configurations of the co-answer graph."""
    return grids.best_trials(_graph(s, d, grids.GRAPH_GRID))


_PA = ", ".join(f"(SELECT unnest([{', '.join(map(repr, v))}]) AS {k})" for k, v in SMALL.items())
_HOW = "CASE mode " + " ".join(f"WHEN '{m}' THEN {f.replace('a.n', 'fs').replace('b.n', 'fd')}" for m, f in _STRENGTH.items()) + " END"


@query(RUNS + EDGES + f""", pa AS (SELECT seeds, power::DOUBLE AS power, mode, min_edge, alpha::DOUBLE AS alpha, base_k FROM {_PA}), pg AS (SELECT DISTINCT seeds, power, mode, min_edge FROM pa),
l AS (SELECT v.qid, v.rank, e.dst, e.cnt, a.n AS fs, b.n AS fd FROM view v JOIN e ON e.src = v.doc_id JOIN fr a ON a.doc_id = e.src JOIN fr b ON b.doc_id = e.dst WHERE v.rank <= 5 AND v.qid IN (SELECT qid FROM gold)),
g AS (SELECT seeds, power, mode, min_edge, qid, dst AS doc_id, sum({_HOW} / pow(rank, power)) AS g FROM l, pg WHERE rank <= seeds AND cnt >= min_edge GROUP BY ALL), gn AS (SELECT *, g / max(g) OVER (PARTITION BY seeds, power, mode, min_edge, qid) AS gn FROM g),
c AS (SELECT seeds, power, mode, min_edge, qid, doc_id, min(rank) AS rank, max(gn) AS gn FROM (SELECT seeds, power, mode, min_edge, qid, doc_id, NULL AS rank, gn FROM gn UNION ALL SELECT seeds, power, mode, min_edge, qid, doc_id, rank, NULL FROM view, pg WHERE qid IN (SELECT qid FROM gold)) GROUP BY ALL),
s AS (SELECT *, round(1 / (base_k + coalesce(rank, 100000)::DOUBLE) + alpha * coalesce(gn, 0) / (base_k + 1), 9) AS score FROM c JOIN pa USING (seeds, power, mode, min_edge)),
r AS (SELECT *, row_number() OVER (PARTITION BY seeds, power, mode, min_edge, alpha, base_k, qid ORDER BY score DESC, doc_id) AS place FROM s QUALIFY place <= 10),
h AS (SELECT seeds, power, mode, min_edge, alpha, base_k, qid, count(*) FILTER (place <= 5) AS h5, sum(1 / log2(place + 1)) AS dcg FROM r SEMI JOIN gold USING (qid, doc_id) GROUP BY ALL),
q AS (SELECT qid, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM gold GROUP BY qid)
SELECT seeds, power, mode, min_edge, alpha, base_k, count(*) AS n, round(avg(coalesce(h5, 0) / q.n), 6) AS recall5, round(avg(coalesce(h5, 0) / 5), 6) AS precision5, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg10 FROM q CROSS JOIN pa LEFT JOIN h USING (seeds, power, mode, min_edge, alpha, base_k, qid) GROUP BY ALL""")
def ml_graph_subgrid(s, d):
    return _graph(s, d, SMALL)


def _questions(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _base(s, d):
    """Question memory as the ranking that the posteriors are blended with."""
    votes = retrieve.memory_votes(checkpointed(neighbours(s, d)), memory_gold(s, d))
    return votes.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc(F.round("vote", 9)), "doc_id")))


@query()
def ml_kernel_grid(s, d):
    """The thirty best of 5,500 configurations of word and character kernels over the labelled questions of other blocks."""
    q, g = _questions(s, d), memory_gold(s, d)

    def channel(features, least):
        w = checkpointed(retrieve.tfidf_weights(q, features, "qid", least))
        return retrieve.kernel(w, w).where("qid % 4 <> other % 4")

    return grids.best_trials(grids.kernel_grid(channel(X.ngram_features(X.tokens(F.col("text"))), 2), channel(X.char_ngrams(X.tokens(F.col("text"))), 2), g, _base(s, d), g))


@query()
def ml_profile_grid(s, d):
    """The thirty best of 7,371 configurations of document profiles."""
    q, g = _questions(s, d), memory_gold(s, d)
    feats = q.select("qid", F.explode(X.ngram_features(X.tokens(F.col("text")))).alias("feature"))
    return grids.best_trials(grids.profile_grid(feats, g.join(feats, "qid"), _base(s, d), g))

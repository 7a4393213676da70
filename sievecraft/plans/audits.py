"""Queries of ceilings, choices, coverage, windows of a reranker, configured rows and similarity, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import ann, chunking, measure, retrieve, rows, sets
from sievecraft.plans.registry import DOC_UNITS, RUNS, TOK, bm25_sql, docs, gold, one, pool, query, ret_doc_runs, runs
from sievecraft.plans.stack import _HELD, _LSTOP, _SHARE, _WIN, FOUR, SCORED
from sievecraft.session import checkpointed, table


@query(RUNS + """, j AS (SELECT g.qid, p.qid IS NOT NULL AS p, coalesce(v.rank, 1000000) AS r FROM gold g LEFT JOIN pool p USING (qid, doc_id) LEFT JOIN click v USING (qid, doc_id)),
q AS (SELECT qid, avg((r <= 5)::INT) AS d5, avg((r <= 20)::INT) AS d20, avg((r <= 50)::INT) AS d50, avg((r <= 100)::INT) AS d100, avg(p::INT) AS c, avg((p OR r <= 10)::INT) AS c10, avg((p OR r <= 20)::INT) AS c20, avg((p OR r <= 50)::INT) AS c50, count(*) FILTER (r <= 20 AND NOT p) AS s, count(*) FILTER (NOT p AND r > 100) AS u FROM j GROUP BY qid)
SELECT count(*) AS queries, round(avg(d5), 6) AS dense5, round(avg(d20), 6) AS dense20, round(avg(d50), 6) AS dense50, round(avg(d100), 6) AS dense100, round(avg(c), 6) AS ceiling, round(avg(c10), 6) AS ceiling_dense10, round(avg(c20), 6) AS ceiling_dense20, round(avg(c50), 6) AS ceiling_dense50, sum(s)::BIGINT AS rescued, sum(u)::BIGINT AS unreachable FROM q""")
def agg_ceilings(s, d):
    return measure.ceilings(pool(s, d), one(s, d, "click"), gold(s, d))


@query(RUNS + """, h AS (SELECT qid, doc_id, branch FROM gold JOIN runs USING (qid, doc_id) WHERE rank <= 5), u AS (SELECT qid, count(DISTINCT doc_id) AS n FROM h GROUP BY qid), b AS (SELECT qid, max(n) AS n FROM (SELECT qid, branch, count(*) AS n FROM h GROUP BY ALL) GROUP BY qid), g AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid)
SELECT count(*) AS queries, round(avg(coalesce(u.n, 0) / g.n), 6) AS "union", round(avg(least(5, coalesce(u.n, 0)) / g.n), 6) AS choice, round(avg(coalesce(b.n, 0) / g.n), 6) AS branch FROM g LEFT JOIN u USING (qid) LEFT JOIN b USING (qid)""")
def agg_choice_oracle(s, d):
    return measure.choice_oracle(runs(s, d), gold(s, d))


@query(RUNS + ", f AS (SELECT v.rank FROM gold g JOIN click c ON c.qid = g.qid AND c.doc_id = g.doc_id AND c.rank <= 5 LEFT JOIN view v ON v.qid = g.qid AND v.doc_id = g.doc_id WHERE v.rank IS NULL OR v.rank > 5) SELECT CASE WHEN rank IS NULL THEN 'missing' WHEN rank <= 10 THEN '6-10' WHEN rank <= 20 THEN '11-20' WHEN rank <= 50 THEN '21-50' ELSE '51+' END AS bucket, count(*) AS n FROM f GROUP BY ALL")
def agg_rescues(s, d):
    return measure.rescues(one(s, d, "view"), one(s, d, "click"), gold(s, d))


@query(RUNS + ", z AS (SELECT qid, count(*) AS size FROM pool GROUP BY qid), h AS (SELECT branch, qid, count(*) AS n FROM pool JOIN runs USING (qid, doc_id) GROUP BY ALL) SELECT branch, round(avg(coalesce(n, 0) / size), 6) AS coverage FROM z CROSS JOIN (SELECT DISTINCT branch FROM runs) LEFT JOIN h USING (branch, qid) GROUP BY branch")
def agg_coverage(s, d):
    return measure.coverage(pool(s, d), runs(s, d))


@query("WITH r AS (SELECT s_suppkey AS id, round(s_acctbal, -2) AS recall, s_nationkey % 7 AS models, s_suppkey % 13 AS features FROM supplier) SELECT id FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.recall >= a.recall AND b.models <= a.models AND b.features <= a.features AND (b.recall > a.recall OR b.features < a.features))")
def join_pareto_two(s, d):
    """The frontier by which fewer models alone do not beat another configuration."""
    r = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round("s_acctbal", -2).alias("recall"), (F.col("s_nationkey") % 7).alias("models"), (F.col("s_suppkey") % 13).alias("features"))
    return sets.pareto(r, strict=("recall", "features")).select("id")


_PW = r"regexp_extract_all(coalesce({}, ''), '\S+')"


@query(bm25_sql(DOC_UNITS, "doc_id", 5) + f""", t0 AS (SELECT bm.qid, bm.doc_id, {_PW.format('b.text')}[1:64] AS q, {_PW.format('d.text')} AS w FROM bm JOIN benchmark b ON b.item_id = bm.qid JOIN documents d USING (doc_id)), t1 AS (SELECT *, 192 - len(q) - 2 AS width FROM t0),
t2 AS (SELECT *, width - least(80, width // 4) AS step FROM t1), t3 AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= width THEN 1 ELSE ceil((len(w) - width) / step)::BIGINT + 1 END)) AS i FROM t2), t4 AS (SELECT *, greatest(least(i * step, len(w) - width), 0) AS st FROM t3),
t5 AS (SELECT qid, doc_id, len(list_filter(list_distinct(q), lambda t: list_contains(w[st + 1 : st + width], t))) / greatest(len(list_distinct(q)), 1) AS score FROM t4), t6 AS (SELECT qid, doc_id, count(*) AS windows, greatest(max(score), 0) AS score FROM t5 GROUP BY ALL)
SELECT qid, doc_id, windows, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM t6""")
def chk_rerank_windows(s, d):
    """Windows of the five best documents of each question; the scorer that stands for a model is the share of the question's words in a window."""
    q = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    win = chunking.rerank_windows(ret_doc_runs(s, d, 5).select("qid", "doc_id").join(q, "qid").join(docs(s, d), "doc_id"), 192, 64)
    asked = F.array_distinct("question")
    score = F.size(F.array_intersect(asked, "words")) / F.greatest(F.size(asked), F.lit(1))
    scored = checkpointed(win.select("qid", "doc_id", score.alias("score")))
    return scored.groupBy("qid", "doc_id").agg(F.count("*").alias("windows")).join(chunking.merged_windows(scored), ["qid", "doc_id"])


@query("WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT x.vec_id AS qid, y.vec_id AS other, round(list_dot_product(x.e, y.e), 6) AS sim FROM a x JOIN a y ON x.vec_id <> y.vec_id) SELECT qid, other, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, other) AS rank FROM p QUALIFY rank <= 5")
def ret_query_pairs(s, d):
    """All pairs of the query vectors, every hundredth."""
    return ann.all_pairs_top(table(s, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding"), 5)


@query(f"""WITH k AS (SELECT item_id AS qid, unnest({TOK}) AS term FROM benchmark), c AS (SELECT qid, term, count(*) AS tf FROM k GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), f AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM c GROUP BY term), v AS (SELECT term, df FROM f, n WHERE df >= 2 AND df <= 0.5 * n ORDER BY cf DESC, term LIMIT 300),
x AS (SELECT qid, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN v USING (term), n), w AS (SELECT qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS w FROM x), s AS (SELECT a.qid, b.qid AS other, round(sum(a.w * b.w), 9) AS sim FROM w a JOIN w b USING (term) WHERE a.qid % 4 <> b.qid % 4 GROUP BY ALL)
SELECT qid, other, round(sim, 6) AS sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, other) AS rank FROM s QUALIFY rank <= 5""")
def ret_masked_kernel(s, d):
    """Nearest questions of other blocks over the 300 most frequent terms that two questions hold at least and half of them at most."""
    b = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    w = checkpointed(retrieve.tfidf_weights(b, X.tokens(F.col("text")), "qid", 2, 0.5, 300))
    return retrieve.masked_kernel(w, b.select("qid", (F.col("qid") % 4).alias("block")), 5)


_X = {"content_full": ("cover_content", "sc0"), "content_local": ("cover_content", "sc1"), "tri_phrase": ("cover_tri", "sc2"), "numbers_memory": ("cover_numbers", "sc3")}


@query(SCORED + rf""", el AS (SELECT qid, doc_id, bool_or(rank <= 3) AS ok FROM runs WHERE branch IN {FOUR} GROUP BY ALL), x AS (SELECT sr.*, el.ok, regexp_extract_all(lower(coalesce(b.text, '')), '[\p{{L}}\p{{N}}_]+') AS q, regexp_extract_all(lower(coalesce(d.text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM sr JOIN el USING (qid, doc_id) JOIN benchmark b ON b.item_id = sr.qid JOIN documents d USING (doc_id)),
y AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS doc, list_distinct(q) AS words, {_WIN(3)} AS tri FROM x), z AS (SELECT *, list_filter(words, lambda t: length(t) >= 3 AND NOT list_contains({_LSTOP}, t)) AS content, list_filter(words, lambda t: regexp_matches(t, '\p{{Nd}}')) AS numbers FROM y),
f AS (SELECT *, CASE WHEN ok THEN {_SHARE(_HELD('content'), 'content')} ELSE 0 END AS cover_content, CASE WHEN ok THEN {_SHARE(_HELD('numbers'), 'numbers')} ELSE 0 END AS cover_numbers, CASE WHEN ok THEN {_SHARE(_HELD('tri'), 'tri')} ELSE 0 END AS cover_tri FROM z)
SELECT qid, doc_id, ok::BIGINT AS eligible, round(ln(1 + length(doc)) / 15, 6) AS doc_length, round(cover_content, 6) AS cover_content, {', '.join(f'round({a} * {b}, 6) AS {n}' for n, (a, b) in _X.items())} FROM f""")
def fea_interactions(s, d):
    """Coverage of the documents that a branch has among its first three, and its products with the branches' scores."""
    scored = rows.score_rows(runs(s, d), FOUR)
    first = runs(s, d).where(F.col("branch").isin(*FOUR)).groupBy("qid", "doc_id").agg((F.min("rank") <= 3).alias("eligible"))
    q = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    pairs = scored.select("qid", "doc_id").join(first, ["qid", "doc_id"]).join(q, "qid").join(docs(s, d), "doc_id")
    made = rows.lexical_interactions(rows.lexical_rows(pairs, F.col("eligible")).join(scored, ["qid", "doc_id"]))
    return made.join(first, ["qid", "doc_id"]).select("qid", "doc_id", F.col("eligible").cast("int").alias("eligible"), "doc_length", "cover_content", *_X)


CONFIG = {"rank_views": ("click", "view"), "score_channels": ("error",), "metadata": ("doc", "pair")}


@query(RUNS + """, lf AS (SELECT doc_id, count(*) AS n FROM gold GROUP BY doc_id), x AS (SELECT qid, doc_id, coalesce(max(rank) FILTER (branch = 'click'), 60) AS c, coalesce(max(rank) FILTER (branch = 'view'), 60) AS v, max(score) FILTER (branch = 'error') AS e, count(branch) AS lists FROM pool LEFT JOIN runs USING (qid, doc_id) GROUP BY ALL),
y AS (SELECT *, coalesce(avg(e) OVER q, 0) AS m, coalesce(nullif(stddev_pop(e) OVER q, 0), 1) AS s, coalesce(max(e) OVER q, 0) AS t FROM x WINDOW q AS (PARTITION BY qid))
SELECT qid, doc_id, round(1.0 / (10 + c), 6) AS rr_click, round(c / 60, 6) AS r_click, round(1.0 / (10 + v), 6) AS rr_view, round(v / 60, 6) AS r_view, least(c, v) AS least_rank, round((c + v) / 2, 6) AS mean_rank, round((coalesce(e, m - 2 * s) - m) / s, 6) AS z_error, round((coalesce(e, m - 2 * s) - t) / s, 6) AS gap_error, coalesce(n, 0) AS doc_answers, lists AS pair_lists FROM y LEFT JOIN lf USING (doc_id)""")
def fea_configured(s, d):
    r = runs(s, d)
    meta = {"doc": gold(s, d).groupBy("doc_id").agg(F.count("*").alias("answers")), "pair": r.groupBy("qid", "doc_id").agg(F.count("*").alias("lists"))}
    return rows.configured_rows(CONFIG, pool(s, d), r, r, meta)

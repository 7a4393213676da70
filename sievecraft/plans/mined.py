"""Queries of mined rows: question memory, negatives, swaps, weights, cross-fitted labels, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import features, fuse, mined, rows
from sievecraft.plans.registry import DOC_UNITS, LAB, RUNS, TOK, bm25_sql, docs, gold, labelled, memory_gold, neighbours, one, query, ret_doc_runs, runs
from sievecraft.session import checkpointed, table

_NB = bm25_sql(f"WITH u AS (SELECT item_id AS other, {TOK} AS w FROM benchmark)", "other", 101) + ", nb AS (SELECT qid, other, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, other) AS rank FROM bm WHERE qid <> other QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, other) <= 100), g AS (SELECT DISTINCT item_id AS other, unnest([item_id % 7, item_id % 5 + 10]) AS doc_id FROM benchmark)"


@query(_NB + """, pm AS (SELECT DISTINCT qid, doc_id FROM nb JOIN g USING (other)), sz AS (SELECT qid, count(*) AS size FROM nb GROUP BY qid), h AS (SELECT qid, doc_id, greatest(score, 0) AS s, rank AS r FROM nb JOIN g USING (other)),
p AS (SELECT qid, doc_id, count(*) AS n, max(s) AS best, avg(s) AS mean, sum(s) AS total, sum(s / (10 + r)) AS votes, sum(s * s) AS votes_sq, sum(1 / r) AS rr, min(r) AS first, count(*) FILTER (r <= 1) AS n1, count(*) FILTER (r <= 5) AS n5, count(*) FILTER (r <= 20) AS n20 FROM h GROUP BY ALL),
nf AS (SELECT doc_id, count(*) AS f FROM g GROUP BY ALL), j AS (SELECT p.*, p.n / size AS share, (f - (o.other IS NOT NULL)::INT) AS freq FROM pm JOIN p USING (qid, doc_id) JOIN sz USING (qid) JOIN nf USING (doc_id) LEFT JOIN g o ON o.other = pm.qid AND o.doc_id = pm.doc_id)
SELECT qid, doc_id, n::DOUBLE AS n, round(best, 6) AS best, round(mean, 6) AS mean, round(total, 6) AS total, round(votes, 6) AS votes, round(votes_sq, 6) AS votes_sq, round(rr, 6) AS rr, first::DOUBLE AS first, n1::DOUBLE AS n1, n5::DOUBLE AS n5, n20::DOUBLE AS n20, round(share, 6) AS share, freq::DOUBLE AS freq, round(ln(1 + freq) / greatest(max(ln(1 + freq)) OVER (PARTITION BY qid), 1), 6) AS prior FROM j""")
def fea_memory(s, d):
    near, g = checkpointed(neighbours(s, d)), memory_gold(s, d)
    pool = near.join(g.withColumnRenamed("qid", "other"), "other").select("qid", "doc_id").distinct()
    return mined.memory_rows(pool, near, g)


for _name, _weight in (("win_weights_equal", "1.0 / count(*) OVER q"), ("win_weights_balanced", "CASE WHEN sum(y) OVER q = 0 THEN 1 WHEN y = 1 THEN count(*) OVER q * 0.5 / sum(y) OVER q ELSE count(*) OVER q * 0.5 / (count(*) OVER q - sum(y) OVER q) END")):

    def _weights(s, d, scheme=_name.rsplit("_", 1)[-1]):
        return features.query_weights(labelled(s, d), scheme)

    _weights.__name__ = _name
    query(LAB + f"SELECT qid, doc_id, y, round({_weight}, 6) AS weight FROM lab WINDOW q AS (PARTITION BY qid)")(_weights)


@query(RUNS + ", g AS (SELECT qid, doc_id, round(sum((CASE branch WHEN 'view' THEN 0.7 ELSE 0.3 END)::DOUBLE / (5.0 + rank)), 9) AS score FROM runs WHERE branch = 'view' AND rank <= 6 OR branch = 'click' AND rank <= 2 GROUP BY ALL) SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM g")
def fus_depths(s, d):
    return fuse.rrf(runs(s, d), {"view": 0.7, "click": 0.3}, 5, missing=None, depth={"view": 6, "click": 2})


#: Small numbers for a run table whose lists hold a few documents.
SMALL = {"hardest": 2, "middle": 2, "disagreement": 2, "confuser": 1, "random": 1}
_ASK = "(SELECT DISTINCT qid FROM view) q"
_LIST = lambda name, source, order: f"LEFT JOIN (SELECT qid, list(doc_id ORDER BY {order}, doc_id) AS {name} FROM ({source}) GROUP BY qid) USING (qid)"
_MIX = "md5(qid || ':0:' || doc_id)"
_FREE = lambda src, n, *taken: f"list_filter({src}, lambda x: NOT list_contains(blocked, x)" + "".join(f" AND NOT list_contains({t}, x)" for t in taken) + f")[1:{n}]"
_STEPS = (("p1", "now", 2), ("p2", "middle", 2), ("p3", "dis", 2), ("p4", "conf", 1), ("p5", "rnd", 1))


def _quota_sql() -> str:
    common = "SELECT qid, doc_id FROM (SELECT qid, doc_id, rank FROM click UNION ALL SELECT qid, doc_id, rank FROM runs WHERE branch = 'signup') JOIN (SELECT qid, least(max(rank) FILTER (branch = 'click'), max(rank) FILTER (branch = 'signup')) AS m FROM runs GROUP BY qid HAVING bool_or(branch = 'click') AND bool_or(branch = 'signup')) USING (qid) WHERE rank <= m AND (qid, doc_id) NOT IN (SELECT qid, doc_id FROM view WHERE rank <= 2) GROUP BY ALL"
    lists = " ".join([
        _LIST("now", "SELECT * FROM view", "rank"), _LIST("middle", "SELECT * FROM view WHERE rank BETWEEN 3 AND 100", _MIX), _LIST("dis", common, _MIX), _LIST("conf", "SELECT * FROM runs WHERE branch = 'purchase'", "rank"),
        _LIST("rnd", f"SELECT q.qid, u.doc_id FROM {_ASK}, (SELECT DISTINCT doc_id FROM runs) u", _MIX), _LIST("blocked", "SELECT * FROM gold", "doc_id"),
    ])
    out = RUNS + f", s0 AS (SELECT qid, {', '.join(f'coalesce({c}, []) AS {c}' for c in ('now', 'middle', 'dis', 'conf', 'rnd', 'blocked'))} FROM {_ASK} {lists})"
    for k, (name, src, n) in enumerate(_STEPS):
        out += f", s{k + 1} AS (SELECT *, {_FREE(src, n, *[x[0] for x in _STEPS[:k]])} AS {name} FROM s{k})"
    taken = [x[0] for x in _STEPS]
    size = lambda names: " + ".join(f"len({x})" for x in names)
    out += f", s6 AS (SELECT *, {_FREE('now', f'greatest(8 - ({size(taken)}), 0)', *taken)} AS p6 FROM s5), s7 AS (SELECT *, {_FREE('rnd', f'greatest(8 - ({size([*taken, "p6"])}), 0)', *taken, 'p6')} AS p7 FROM s6)"
    labels = dict(zip((*taken, "p6", "p7"), ("hardest", "middle", "disagreement", "confuser", "random", "backfill", "backfill_random")))
    every = " || ".join(f"list_transform({k}, lambda x: {{'d': x, 's': '{v}'}})" for k, v in labels.items())
    return out + f", e AS (SELECT qid, {every} AS l FROM s7) SELECT qid, l[i].d AS doc_id, l[i].s AS source, i::BIGINT AS pick FROM (SELECT qid, l, unnest(range(1, len(l) + 1)) AS i FROM e)"


@query(_quota_sql())
def ml_hard_negatives(s, d):
    r = runs(s, d)
    of = lambda b: one(s, d, b)
    return mined.quota_negatives(of("view"), of("click"), of("signup"), of("purchase"), r.select("doc_id").distinct(), gold(s, d), quotas=SMALL)


_ACT = RUNS + ", ac AS (SELECT n.qid, n.doc_id AS challenger, o.doc_id AS incumbent, n.rank / 20 AS new_rank FROM view n JOIN view o ON o.qid = n.qid AND o.rank = 5 JOIN view m ON m.qid = n.qid AND m.rank = 6 WHERE n.rank BETWEEN 6 AND 20), gn AS (SELECT qid, count(*) AS gn FROM gold GROUP BY qid), tg AS (SELECT ac.*, ((c.qid IS NOT NULL)::INT - (i.qid IS NOT NULL)::INT) / gn AS target FROM ac JOIN gn USING (qid) LEFT JOIN gold c ON c.qid = ac.qid AND c.doc_id = challenger LEFT JOIN gold i ON i.qid = ac.qid AND i.doc_id = incumbent)"


@query(_ACT + " SELECT qid, challenger, incumbent, round(new_rank, 6) AS new_rank, round(target, 6) AS target, CASE WHEN target <> 0 THEN 1.0 ELSE 0.15 END::DOUBLE AS weight FROM tg")
def ml_action_targets(s, d):
    return mined.action_targets(rows.actions(one(s, d, "view"), ("score",)), gold(s, d)).select("qid", "challenger", "incumbent", "new_rank", "target", "weight")


@query(_ACT + ", b AS (SELECT qid, challenger AS new FROM ac WHERE challenger % 7 > 3 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY challenger % 7 DESC, new_rank) = 1) SELECT qid, coalesce(CASE WHEN rank = 5 THEN new END, doc_id) AS doc_id, rank FROM view LEFT JOIN b USING (qid) WHERE rank <= 5")
def ml_swap(s, d):
    """A stated utility (challenger % 7 - 3) in the place of a learned one."""
    run = one(s, d, "view")
    return mined.swapped(run, rows.actions(run, ()).select("qid", "challenger", "new_rank", (F.col("challenger") % 7 - 3).alias("utility")))


@query()
def ml_utility_gate(s, d):
    """Trees learn what a swap gains; each third of the queries is answered by the trees of the others."""
    run = one(s, d, "view")
    columns = ("c_score", "i_score", "d_score", "margin", "new_rank")
    acts = mined.action_targets(rows.actions(run, ("score",)), gold(s, d)).withColumn("fold", F.col("qid") % 3)
    return mined.swapped(run, mined.utility_gate(acts, columns))


_LOOSE = r"(?i)(\d+[/.](?:\d{4}[/.])?[A-ZĐƯƠ\-]{2,})"


@query(bm25_sql(DOC_UNITS, "doc_id", 20) + f", ow AS (SELECT doc_id, upper(regexp_extract(substring(coalesce(text, ''), 1, 300), '{_LOOSE}', 1)) AS own FROM documents), qu AS (SELECT item_id AS qid, list_transform(regexp_extract_all(coalesce(text, ''), '{_LOOSE}', 1), lambda x: upper(x)) AS numbers FROM benchmark) SELECT qid, doc_id, (own <> '' AND list_contains(numbers, own))::INT::DOUBLE AS named FROM bm JOIN ow USING (doc_id) JOIN qu USING (qid)")
def fea_query_cites(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), X.named_numbers(F.col("text")).alias("numbers"))
    return mined.named_in_question(ret_doc_runs(s, d, 20), q, docs(s, d).select("doc_id", X.own_number(F.col("text"), 300, X.LOOSE_NUMBER).alias("own")))


@query(RUNS + ", f AS (SELECT DISTINCT qid, qid % 5 AS fold FROM gold), p AS (SELECT fold AS sf, doc_id, count(*) AS n FROM gold JOIN f USING (qid) GROUP BY ALL) SELECT o.fold AS outer_fold, g.qid, g.doc_id, coalesce(sum(n) FILTER (sf <> f.fold AND sf <> o.fold), 0)::BIGINT AS freq FROM gold g JOIN f USING (qid) CROSS JOIN (SELECT DISTINCT fold FROM f) o LEFT JOIN p ON p.doc_id = g.doc_id GROUP BY ALL")
def ml_crossfit_labels(s, d):
    g = gold(s, d)
    return mined.crossfit_frequency(g.select("qid").distinct().withColumn("fold", F.col("qid") % 5), g)

"""Queries of the ranking stack: feature rows, staged fusions, audits and choices, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import chunking, features, fuse, learn, measure, retrieve, rows, sets, validate
from sievecraft.plans.registry import DOC_UNITS, RUNS, TOK, bm25_sql, docs, gold, labelled, met_sql, one, pool, query, ret_doc_runs, rrf_sql, runs
from sievecraft.session import table

#: Lists that stand for whole documents, passages, phrases and question memory.
FOUR = ("view", "click", "purchase", "signup")

# ---------------------------------------------------------------- feature rows

_RR = ", ".join(f"coalesce(max(1.0 / (5 + rank)) FILTER (branch = '{b}'), 0) AS rr{k}, coalesce(max(sc) FILTER (branch = '{b}'), 0) AS sc{k}, (count(*) FILTER (branch = '{b}') > 0)::INT::DOUBLE AS here{k}" for k, b in enumerate(FOUR))
_SUM = lambda x: " + ".join(f"{x}{k}" for k in range(4))
_MAX = lambda x: "greatest(" + ", ".join(f"{x}{k}" for k in range(4)) + ")"
SCORED = RUNS + f""", rel AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY qid, branch) > 0 THEN score / max(score) OVER (PARTITION BY qid, branch) ELSE 0 END AS sc FROM runs WHERE branch IN {FOUR}),
p4 AS (SELECT qid, doc_id, {_RR} FROM rel GROUP BY ALL HAVING min(rank) <= 150),
sr AS (SELECT *, {_SUM('here')} AS lists, {_SUM('rr')} AS rr_sum, {_SUM('sc')} AS sc_sum, {_MAX('rr')} AS rr_max, {_MAX('sc')} AS sc_max, here1 * here2 AS here12, here2 * here3 AS here23, here1 * here3 AS here13, sc1 * sc2 AS sc12, sc2 * sc3 AS sc23, sc1 * sc3 AS sc13 FROM p4)"""
_SCORE_COLS = [*(f"{x}{k}" for x in ("rr", "sc", "here") for k in range(4)), "lists", "rr_sum", "sc_sum", "rr_max", "sc_max", "here12", "here23", "here13", "sc12", "sc23", "sc13"]
_six = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query(SCORED + f" SELECT qid, doc_id, {_six(_SCORE_COLS)} FROM sr")
def fea_score_rows(s, d):
    return rows.score_rows(runs(s, d), FOUR)


_LABEL_COLS = "prior unseen rare lex_support lex_rr lex_sc best_lex mem_rr mem_sc two three cold_two sc_less_memory rr_less_memory prior_mem_sc prior_mem_rr unseen_lex_sc unseen_lex_rr unseen_best two_best two_less".split()


@query(SCORED + f""", lf AS (SELECT doc_id, count(*) AS f FROM gold GROUP BY ALL), n0 AS (SELECT sr.*, greatest(coalesce(f, 0) - (g.qid IS NOT NULL)::INT, 0) AS n FROM sr LEFT JOIN lf USING (doc_id) LEFT JOIN gold g ON g.qid = sr.qid AND g.doc_id = sr.doc_id),
n1 AS (SELECT *, ln(1 + n) / greatest(max(ln(1 + n)) OVER (PARTITION BY qid), 1) AS prior, (n = 0)::INT AS unseen, (n <= 1)::INT AS rare, here0 + here1 + here2 AS su, rr0 + rr1 + rr2 AS lex_rr, sc0 + sc1 + sc2 AS lex_sc, greatest(sc0, sc1, sc2) AS best_lex, rr3 AS mem_rr, sc3 AS mem_sc FROM n0),
n2 AS (SELECT *, su / 3 AS lex_support, (su >= 2)::INT AS two, (su >= 3)::INT AS three, lex_sc - sc3 AS sc_less_memory, lex_rr - rr3 AS rr_less_memory, prior * sc3 AS prior_mem_sc, prior * rr3 AS prior_mem_rr, unseen * lex_sc AS unseen_lex_sc, unseen * lex_rr AS unseen_lex_rr, unseen * best_lex AS unseen_best FROM n1),
n3 AS (SELECT *, unseen * two AS cold_two, two * best_lex AS two_best, two * sc_less_memory AS two_less FROM n2) SELECT qid, doc_id, {_six([c for c in _LABEL_COLS if c not in ("unseen", "rare", "two", "three", "cold_two")])}, unseen::DOUBLE AS unseen, rare::DOUBLE AS rare, two::DOUBLE AS two, three::DOUBLE AS three, cold_two::DOUBLE AS cold_two FROM n3""")
def fea_label_rows(s, d):
    return rows.label_rows(rows.score_rows(runs(s, d), FOUR), gold(s, d)).select("qid", "doc_id", *_LABEL_COLS)


_BASE = "CASE branch " + " ".join(f"WHEN '{b}' THEN {w}" for b, w in zip(FOUR, rows.BASE_WEIGHTS)) + " END"
BASE = f", bg AS (SELECT qid, doc_id, round(sum({_BASE} / (5.0 + rank) - {_BASE} / 100005.0) + {sum(rows.BASE_WEIGHTS) / 100005!r}, 9) AS score FROM runs WHERE branch IN {FOUR} GROUP BY ALL), br AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bg)"


@query(RUNS + BASE + " SELECT qid, doc_id, " + ", ".join(f"round(1 / ({k}.0 + rank), 6) AS t{k}" for k in rows.TEMPERATURES) + " FROM pool JOIN br USING (qid, doc_id)")
def fea_temperatures(s, d):
    base = rows.base_rank(runs(s, d), FOUR)
    return rows.temperature_rows(pool(s, d).join(base.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi"), base)


_LSTOP = "[" + ", ".join(f"'{w}'" for w in X.LEGAL_STOP_WORDS) + "]"
_WIN = lambda n: f"list_distinct(list_transform(range(1, greatest(len(q) - {n - 1}, 0) + 1), lambda i: array_to_string(q[i : i + {n - 1}], ' ')))"
_HELD = lambda c: f"len(list_filter({c}, lambda x: contains(doc, ' ' || x || ' ')))"
_SHARE = lambda n, c: f"CASE WHEN len({c}) > 0 THEN {n} / len({c}) ELSE 0 END"


@query(bm25_sql(DOC_UNITS, "doc_id", 20) + rf""", x AS (SELECT bm.qid, bm.doc_id, list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '(?i)(?:điều|khoản|điểm|mục|chương)\s+[\p{{L}}\p{{N}}_.-]+|\b\d{{1,4}}/\d{{2,4}}/[\p{{L}}\p{{N}}_-]+\b')) AS cites, regexp_extract_all(lower(coalesce(b.text, '')), '[\p{{L}}\p{{N}}_]+') AS q, regexp_extract_all(lower(coalesce(d.text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM bm JOIN benchmark b ON b.item_id = bm.qid JOIN documents d USING (doc_id)),
y AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS doc, list_distinct(q) AS words, {_WIN(2)} AS bi, {_WIN(3)} AS tri FROM x), z AS (SELECT *, list_filter(words, lambda t: length(t) >= 3 AND NOT list_contains({_LSTOP}, t)) AS content, list_filter(words, lambda t: regexp_matches(t, '\p{{Nd}}')) AS numbers FROM y)
SELECT qid, doc_id, round({_SHARE(_HELD('words'), 'words')}, 6) AS cover, round({_SHARE(_HELD('content'), 'content')}, 6) AS cover_content, round({_SHARE(_HELD('numbers'), 'numbers')}, 6) AS cover_numbers, (len(numbers) > 0 AND {_HELD('numbers')} = len(numbers))::INT::DOUBLE AS all_numbers, round({_SHARE(_HELD('bi'), 'bi')}, 6) AS cover_bi, round({_SHARE(_HELD('tri'), 'tri')}, 6) AS cover_tri, ({_HELD('tri')} > 0)::INT::DOUBLE AS any_tri,
round({_SHARE("len(list_filter(cites, lambda c: contains(doc, c)))", 'cites')}, 6) AS cover_cites, (len(cites) > 0 AND len(list_filter(cites, lambda c: contains(doc, c))) = len(cites))::INT::DOUBLE AS all_cites, round(ln(1 + length(doc)) / 15, 6) AS doc_length FROM z""")
def fea_lexical(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return rows.lexical_rows(ret_doc_runs(s, d, 20).select("qid", "doc_id").join(q, "qid").join(docs(s, d), "doc_id"))


@query(bm25_sql(DOC_UNITS, "doc_id", 20) + r""", h AS (SELECT doc_id, upper(substring(coalesce(text, ''), 1, 400)) AS h FROM documents), kd AS (SELECT doc_id, CASE WHEN regexp_matches(h, 'LUẬT\s+SỐ|LUẬT\s*[:\n]') OR contains(substring(h, 1, 100), 'QUỐC HỘI') THEN 'LUAT' WHEN contains(h, 'NGHỊ ĐỊNH') THEN 'NGHIDINH' WHEN contains(h, 'THÔNG TƯ') THEN 'THONGTU' WHEN contains(h, 'QUYẾT ĐỊNH') THEN 'QUYETDINH' WHEN contains(h, 'V/V') OR contains(h, 'CÔNG VĂN') THEN 'CONGVAN' ELSE 'KHAC' END AS kind FROM h),
x AS (SELECT qid, doc_id, kind, count(*) OVER (PARTITION BY qid, kind) / count(*) OVER (PARTITION BY qid) AS share FROM bm JOIN kd USING (doc_id)), q AS (SELECT item_id AS qid, lower(coalesce(text, '')) AS q FROM benchmark)
SELECT qid, doc_id, (kind = 'LUAT')::INT::DOUBLE AS is_luat, (kind = 'NGHIDINH')::INT::DOUBLE AS is_nghidinh, (kind = 'THONGTU')::INT::DOUBLE AS is_thongtu, (kind = 'QUYETDINH')::INT::DOUBLE AS is_quyetdinh, (kind = 'CONGVAN')::INT::DOUBLE AS is_congvan, (kind = 'KHAC')::INT::DOUBLE AS is_khac, round(share, 6) AS share,
contains(q, 'luật')::INT::DOUBLE AS hint_luat, contains(q, 'nghị định')::INT::DOUBLE AS hint_nghidinh, contains(q, 'thông tư')::INT::DOUBLE AS hint_thongtu, contains(q, 'quyết định')::INT::DOUBLE AS hint_quyetdinh, (contains(q, 'công văn') OR contains(q, 'hướng dẫn'))::INT::DOUBLE AS hint_congvan FROM x JOIN q USING (qid)""")
def fea_type(s, d):
    kinds = docs(s, d).select("doc_id", X.doc_class(F.col("text")).alias("kind"))
    hints = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), *X.question_hints(F.col("text")))
    return rows.class_rows(ret_doc_runs(s, d, 20), kinds, hints)


_Z = lambda c: f"coalesce(avg({c}) OVER q, 0) AS m_{c}, coalesce(nullif(stddev_pop({c}) OVER q, 0), 1) AS s_{c}, coalesce(max({c}) OVER q, 0) AS t_{c}"


@query(RUNS + f""", x AS (SELECT qid, doc_id, coalesce(max(rank) FILTER (branch = 'click'), 60) AS c, coalesce(max(rank) FILTER (branch = 'view'), 60) AS v, max(score) FILTER (branch = 'error') AS error, max(score) FILTER (branch = 'signup') AS signup FROM pool LEFT JOIN runs USING (qid, doc_id) GROUP BY ALL),
y AS (SELECT *, {_Z('error')}, {_Z('signup')} FROM x WINDOW q AS (PARTITION BY qid)) SELECT qid, doc_id, round(1.0 / (10 + c), 6) AS rr_click, round(1.0 / (10 + v), 6) AS rr_view, round(c / 60, 6) AS r_click, round(v / 60, 6) AS r_view, least(c, v) AS least_rank, round((c + v) / 2, 6) AS mean_rank,
round((coalesce(error, m_error - 2 * s_error) - m_error) / s_error, 6) AS z_error, round((coalesce(error, m_error - 2 * s_error) - t_error) / s_error, 6) AS gap_error, round((coalesce(signup, m_signup - 2 * s_signup) - m_signup) / s_signup, 6) AS z_signup, round((coalesce(signup, m_signup - 2 * s_signup) - t_signup) / s_signup, 6) AS gap_signup FROM y""")
def fea_fused(s, d):
    r = runs(s, d)
    return rows.fused_rows(pool(s, d), r, ("click", "view"), r, ("signup", "error"))


@query(RUNS + ", x AS (SELECT p.qid, p.doc_id, v.score AS sim FROM pool p LEFT JOIN view v USING (qid, doc_id)), y AS (SELECT *, coalesce(avg(sim) OVER q, 0) AS m, coalesce(nullif(stddev_pop(sim) OVER q, 0), 1) AS s, coalesce(max(sim) OVER q, 0) AS t FROM x WINDOW q AS (PARTITION BY qid)) SELECT qid, doc_id, round((coalesce(sim, m - 2 * s) - m) / s, 6) AS z, round(coalesce(sim, m - 2 * s) - t, 6) AS gap, (sim IS NOT NULL)::INT::DOUBLE AS has FROM y")
def win_similarity(s, d):
    return rows.similarity_rows(pool(s, d).join(one(s, d, "view").select("qid", "doc_id", F.col("score").alias("sim")), ["qid", "doc_id"], "left"))


@query(RUNS + "SELECT a.qid, round(a.score - b.score, 6) AS margin FROM view a JOIN view b USING (qid) WHERE a.rank = 5 AND b.rank = 6")
def win_boundary_margin(s, d):
    return rows.boundary_margin(one(s, d, "view"))


@query(RUNS + "SELECT n.qid, n.doc_id AS challenger, o.doc_id AS incumbent, n.score AS c_score, o.score AS i_score, round(n.score - o.score, 6) AS d_score, round(n.score - o.score, 6) AS score_less, round(o.score - m.score, 6) AS margin, 0.25::DOUBLE AS old_rank, round(n.rank / 20, 6) AS new_rank FROM view n JOIN view o ON o.qid = n.qid AND o.rank = 5 JOIN view m ON m.qid = n.qid AND m.rank = 6 WHERE n.rank BETWEEN 6 AND 20")
def fea_actions(s, d):
    return rows.actions(one(s, d, "view"), ("score",))


_MIRROR = RUNS + BASE + ", lab AS (SELECT p.qid, p.doc_id, (g.qid IS NOT NULL)::BIGINT AS y, coalesce(v.score, 0) AS s, br.rank AS pos_ FROM pool p LEFT JOIN gold g USING (qid, doc_id) LEFT JOIN view v USING (qid, doc_id) LEFT JOIN br USING (qid, doc_id)), neg AS (SELECT * FROM lab WHERE y = 0 AND pos_ <= 100 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos_, doc_id) <= 40), pr AS (SELECT p.qid, p.doc_id AS pos, n.doc_id AS neg, p.s - n.s AS s FROM lab p JOIN neg n USING (qid) WHERE p.y = 1)"


def _mirrored(s, d):
    x = labelled(s, d).join(one(s, d, "view").select("qid", "doc_id", F.col("score").alias("s")), ["qid", "doc_id"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return rows.mirrored_pairs(x, rows.base_rank(runs(s, d), FOUR), ("s",))


@query(_MIRROR + " SELECT qid, pos, neg, 1::BIGINT AS y, round(s, 6) AS s FROM pr UNION ALL SELECT qid, pos, neg, 0::BIGINT AS y, round(-s, 6) AS s FROM pr")
def fea_pairs_mirrored(s, d):
    return _mirrored(s, d)


@query(RUNS + ", f AS (SELECT qid, doc_id, min({'rank': rank, 'branch': branch}) AS o FROM runs GROUP BY ALL), n AS (SELECT qid, doc_id, 0::BIGINT AS y, row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS pick FROM f ANTI JOIN gold USING (qid, doc_id) QUALIFY pick <= 8), g AS (SELECT qid, doc_id, 1::BIGINT AS y, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS pick FROM gold) SELECT * FROM g WHERE qid IN (SELECT qid FROM n) UNION ALL SELECT * FROM n WHERE qid IN (SELECT qid FROM g)")
def ml_training_pool(s, d):
    return rows.training_pool(runs(s, d), gold(s, d), 8)


# ---------------------------------------------------------------- staged fusions

@query("SELECT * FROM (" + rrf_sql({"view": 0.55, "click": 0.45}, 10, 100_000, None) + ") WHERE rank <= 20")
def fus_expansion(s, d):
    return fuse.rrf(runs(s, d), {"view": 0.55, "click": 0.45}, 10, cap=20)


@query("SELECT * FROM (" + rrf_sql({"view": 0.5, "click": 0.2, "purchase": 0.3}, 20, 100_000, None) + ") WHERE rank <= 5")
def fus_three_view(s, d):
    return fuse.rrf(runs(s, d), {"view": 0.5, "click": 0.2, "purchase": 0.3}, 20, cap=5)


def _stage(name: str, source: str, weights: dict, k: int) -> str:
    w = "CASE branch " + " ".join(f"WHEN '{b}' THEN {v}" for b, v in weights.items()) + " END"
    missing = sum(weights.values()) / (k + 100_000)
    return f"{name}0 AS (SELECT qid, doc_id, round(sum({w}::DOUBLE / ({k}.0 + rank) - {w}::DOUBLE / {k + 100_000}.0) + {missing!r}, 9) AS score FROM {source} GROUP BY ALL), {name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {name}0)"


_ROBUST, _STACK = {"view": 0.725, "click": 0.275}, {"robust": 0.4, "purchase": 0.3, "signup": 0.15, "error": 0.15}


@query(RUNS + ", r1 AS (SELECT * FROM runs WHERE branch = 'view' AND rank <= 100 OR branch = 'click' AND rank <= 10), " + _stage("robust", "r1", _ROBUST, 40) + ", r2 AS (SELECT qid, doc_id, 'robust' AS branch, rank FROM robust UNION ALL SELECT qid, doc_id, branch, rank FROM runs WHERE branch IN ('purchase', 'signup', 'error')), " + _stage("st", "r2", _STACK, 0) + " SELECT qid, doc_id, round(score, 6) AS score, rank FROM st WHERE rank <= 5")
def fus_multistage(s, d):
    r = runs(s, d)
    robust = fuse.rrf(r.where("branch = 'view' and rank <= 100 or branch = 'click' and rank <= 10"), _ROBUST, 40)
    every = robust.select("qid", "doc_id", F.lit("robust").alias("branch"), "rank").unionByName(r.select("qid", "doc_id", "branch", "rank"))
    return fuse.rrf(every, _STACK, 0, cap=5)


# ---------------------------------------------------------------- text, chunks, duplicates


@query("SELECT item_id AS qid, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(\\d+[/.](?:\\d{4}[/.])?[A-ZĐƯƠ\\-]{2,})', 1), lambda x: upper(x))))::BIGINT AS named, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '(?i)(?:điều|khoản|điểm|mục|chương)\\s+[\\p{L}\\p{N}_.-]+|\\b\\d{1,4}/\\d{2,4}/[\\p{L}\\p{N}_-]+\\b')))::BIGINT AS refs FROM benchmark")
def txt_question_numbers(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.size(X.named_numbers(F.col("text"))).alias("named"), F.size(X.legal_references(F.col("text"))).alias("refs"))


@query(f"""WITH t AS (SELECT item_id, item_id % 5 AS fold, array_to_string({TOK}, ' ') AS t FROM benchmark UNION ALL SELECT doc_id, doc_id % 5, array_to_string({TOK}, ' ') FROM documents), n AS (SELECT t, count(*) AS n, count(DISTINCT fold) AS folds, count(DISTINCT item_id % 7) AS answers FROM t GROUP BY t HAVING count(*) > 1)
SELECT md5(t) AS h, n, (folds > 1)::BIGINT AS cross_fold, (answers = 1)::BIGINT AS same_answer FROM n""")
def ret_dup_folds(s, d):
    b = table(s, d, "benchmark").select("item_id", "text").unionByName(docs(s, d).select(F.col("doc_id").alias("item_id"), "text"))
    t = b.select("item_id", (F.col("item_id") % 5).alias("fold"), F.array_join(X.tokens(F.col("text")), " ").alias("t"))
    n = t.groupBy("t").agg(F.count("*").alias("n"), F.countDistinct("fold").alias("folds"), F.countDistinct(F.col("item_id") % 7).alias("answers")).where("n > 1")
    return n.select(F.md5(F.col("t").cast("binary")).alias("h"), "n", (F.col("folds") > 1).cast("int").alias("cross_fold"), (F.col("answers") == 1).cast("int").alias("same_answer"))


_GRAMS = f"""w AS (SELECT item_id AS qid, unnest({TOK}) AS w FROM benchmark), p AS (SELECT qid, ' ' || w || ' ' AS p, n FROM w, (SELECT unnest([3, 4, 5]) AS n)), k AS (SELECT qid, substring(p, i::INT, n::INT) AS term FROM (SELECT qid, p, n, unnest(range(1, greatest(length(p) - n + 1, 0) + 1)) AS i FROM p)),
c AS (SELECT qid, term, count(*) AS tf FROM k GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), f AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2), x AS (SELECT qid, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN f USING (term), n), v AS (SELECT qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS w FROM x),
s AS (SELECT a.qid, b.qid AS other, round(sum(a.w * b.w), 9) AS sim FROM v a JOIN v b USING (term) WHERE a.qid <> b.qid GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, other) AS rank FROM s)"""


@query(f"WITH {_GRAMS} SELECT least(qid, other) AS a, greatest(qid, other) AS b, round(max(sim), 6) AS sim FROM r WHERE rank <= 5 AND sim >= 0.2 AND qid % 5 <> other % 5 GROUP BY ALL")
def ret_near_dups(s, d):
    b = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieve.near_questions(b, b.select("qid", (F.col("qid") % 5).alias("fold")), X.char_ngrams(X.tokens(F.col("text"))), 0.2)


@query(bm25_sql(DOC_UNITS, "doc_id", 10) + ", e AS (SELECT qid, doc_id, CASE WHEN rank <= 3 THEN 0 END AS c1, CASE WHEN rank <= 6 THEN 1 END AS c2 FROM bm) SELECT qid, doc_id, coalesce(c1, c2, 0)::BIGINT AS chunk_no, CASE WHEN c1 IS NOT NULL THEN 'first' WHEN c2 IS NOT NULL THEN 'second' ELSE 'lead' END AS selector FROM e")
def chk_evidence(s, d):
    r = ret_doc_runs(s, d, 10)
    at = lambda most, no: r.where(F.col("rank") <= most).select("qid", "doc_id", F.lit(no).alias("chunk_id"))
    windows = chunking.token_windows(docs(s, d)).select("doc_id", F.col("chunk_no").alias("chunk_id"))
    return chunking.chosen_evidence(r, at(3, 0), at(6, 1), windows).withColumnRenamed("chunk_id", "chunk_no")


# ---------------------------------------------------------------- audits and choices


@query(RUNS + ", a AS (SELECT qid, list(doc_id ORDER BY rank) AS a FROM view WHERE rank <= 5 GROUP BY qid), b AS (SELECT qid, list(doc_id ORDER BY rank) AS b FROM click WHERE rank <= 5 GROUP BY qid) SELECT qid, (list_sort(a) <> list_sort(b))::BIGINT AS set_differs, (a <> b)::BIGINT AS order_differs, len(list_intersect(a, b))::BIGINT AS shared, (len(a) - len(list_intersect(a, b)))::BIGINT AS gone FROM a JOIN b USING (qid)")
def set_churn(s, d):
    return sets.churn(one(s, d, "view"), one(s, d, "click"))


@query(RUNS + ", a AS (SELECT qid, doc_id, 0 AS src, rank AS pos FROM view WHERE rank <= 3 UNION ALL SELECT qid, doc_id, 1, row_number() OVER (PARTITION BY qid ORDER BY doc_id) FROM (SELECT DISTINCT qid FROM view), (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10)), o AS (SELECT qid, doc_id, min({'s': src, 'p': pos}) AS o FROM a GROUP BY ALL), p AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS pool_pos FROM o) SELECT * FROM p WHERE pool_pos <= 5")
def set_fill_all(s, d):
    return sets.fill_from_all(one(s, d, "view").where("rank <= 3").select("qid", "doc_id", F.col("rank").alias("pool_pos")), docs(s, d).select("doc_id"))


_TOP = lambda run, name: f"{name} AS (SELECT qid, list(doc_id) AS {name[-1]} FROM {run} WHERE rank <= 5 GROUP BY qid)"


@query(RUNS + ", gg AS (SELECT qid, list(doc_id) AS g, qid % 5 AS fold FROM gold GROUP BY qid), " + _TOP("view", "ta") + ", " + _TOP("click", "tb") + ", j AS (SELECT fold, g, coalesce(a, []) AS a, coalesce(b, []) AS b FROM gg LEFT JOIN ta USING (qid) LEFT JOIN tb USING (qid)), k AS (SELECT fold, (len(list_intersect(b, g)) - len(list_intersect(a, g))) / len(g) AS delta, (list_sort(a) <> list_sort(b))::INT AS churn, len(list_filter(list_intersect(b, g), lambda x: NOT list_contains(a, x))) AS into_, len(list_filter(list_intersect(a, g), lambda x: NOT list_contains(b, x))) AS out_ FROM j), f AS (SELECT fold, avg(delta) AS m FROM k GROUP BY fold) SELECT count(*) AS n, round(avg(delta), 6) AS delta, (SELECT round(min(m), 6) FROM f) AS worst_fold, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, sum(churn)::BIGINT AS churn, sum(into_)::BIGINT AS \"into\", sum(out_)::BIGINT AS \"out\" FROM k")
def agg_compare_folds(s, d):
    g = gold(s, d)
    return measure.compare_by_fold(one(s, d, "view"), one(s, d, "click"), g, g.select("qid").distinct().withColumn("fold", F.col("qid") % 5))


@query(RUNS + ", " + met_sql("view", "m") + ", f AS (SELECT qid % 5 AS fold, count(*) AS n, avg(recall5) AS recall5, avg(ndcg10) AS ndcg10 FROM m GROUP BY fold) SELECT sum(n)::BIGINT AS n, round(sum(recall5 * n) / sum(n), 6) AS recall5, round(sum(ndcg10 * n) / sum(n), 6) AS ndcg10 FROM f")
def agg_weighted_folds(s, d):
    m = measure.query_metrics(one(s, d, "view"), gold(s, d)).withColumn("fold", F.col("qid") % 5)
    return measure.weighted_mean(m.groupBy("fold").agg(F.count("*").alias("n"), F.avg("recall5").alias("recall5"), F.avg("ndcg10").alias("ndcg10")), ("recall5", "ndcg10"))


@query(RUNS + ", u AS (SELECT DISTINCT branch AS config, doc_id AS model FROM runs WHERE rank <= 2) SELECT config, count(*) AS models, sum(1000 * (model + 1))::BIGINT AS parameters FROM u GROUP BY config")
def agg_complexity(s, d):
    used = runs(s, d).where("rank <= 2").select(F.col("branch").alias("config"), F.col("doc_id").alias("model"))
    return measure.complexity(used, s.range(89).select(F.col("id").alias("model"), (1000 * (F.col("id") + 1)).alias("parameters")))


@query(RUNS + "SELECT branch AS label, count(*) AS n, count(*) FILTER (score < 100) AS bad, (count(*) FILTER (score < 100) > 0.5 * count(*))::BIGINT AS failed FROM runs GROUP BY branch")
def agg_bad_share(s, d):
    return measure.bad_share(runs(s, d).select(F.col("branch").alias("label"), F.when(F.col("score") < 100, F.lit(float("nan"))).otherwise(F.col("score")).alias("score")))


for _name, _how in (("agg_pooled_max", "max"), ("agg_pooled_mean", "avg")):

    def _pooled(s, d, how="mean" if _how == "avg" else "max"):
        return measure.pooled_scores(runs(s, d).select("qid", F.col("doc_id").alias("doc_id"), F.col("score"), F.row_number().over(features.W.partitionBy("qid", "doc_id").orderBy("branch")).alias("passage")), 2, how)

    _pooled.__name__ = _name
    query(RUNS + f"SELECT qid, doc_id, round({_how}(score), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY branch) AS p FROM runs) WHERE p <= 2 GROUP BY ALL")(_pooled)


@query(RUNS + ", h AS (SELECT qid, doc_id, branch, rank FROM runs SEMI JOIN gold USING (qid, doc_id)), e AS (SELECT * FROM h UNION ALL SELECT qid, doc_id, 'all', min(rank) FROM h GROUP BY ALL) SELECT depth::BIGINT AS depth, branch, count(*) FILTER (rank <= depth) AS found FROM e, (SELECT unnest([5, 20, 50, 100]) AS depth) GROUP BY ALL")
def agg_headroom(s, d):
    return measure.headroom(runs(s, d), gold(s, d))


@query(RUNS + "SELECT count(*) AS queries, count(*) FILTER (a.l IS DISTINCT FROM b.l) AS changed FROM (SELECT qid, list_sort(list(doc_id)) AS l FROM view WHERE rank <= 5 GROUP BY qid) a FULL JOIN (SELECT qid, list_sort(list(doc_id)) AS l FROM click WHERE rank <= 5 GROUP BY qid) b USING (qid)")
def val_membership(s, d):
    return validate.membership(one(s, d, "view").where("rank <= 5"), one(s, d, "click").where("rank <= 5"))


@query(RUNS + "SELECT count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (e IS NULL) AS extra, count(*) FILTER (n > 1) AS repeated FROM (SELECT qid, count(*) AS n FROM view GROUP BY qid) FULL JOIN (SELECT DISTINCT qid, 1 AS e FROM gold) USING (qid)")
def val_covers(s, d):
    return validate.covers(one(s, d, "view"), gold(s, d), "qid")


_TRIALS = RUNS + ", t AS (SELECT branch AS config, qid % 4 AS block, qid, count(*) FILTER (rank <= 5) AS hits FROM runs SEMI JOIN gold USING (qid, doc_id) GROUP BY ALL), b AS (SELECT config, block, sum(hits)::DOUBLE AS recall, sum(hits) / (5.0 * count(*)) AS precision FROM t GROUP BY ALL)"


def _trials(s, d):
    t = runs(s, d).join(gold(s, d), ["qid", "doc_id"], "left_semi").groupBy(F.col("branch").alias("config"), (F.col("qid") % 4).alias("block"), "qid").agg(F.count_if(F.col("rank") <= 5).alias("hits"))
    return t.groupBy("config", "block").agg(F.sum("hits").cast("double").alias("recall"), (F.sum("hits") / (5.0 * F.count("*"))).alias("precision"))


@query(_TRIALS + ", p AS (SELECT config, min(recall) AS low, avg(recall) AS mean, avg(precision) AS precision FROM b GROUP BY config) SELECT config, low, round(mean, 6) AS mean, round(precision, 6) AS precision, row_number() OVER (ORDER BY low DESC, mean DESC, precision DESC, config) AS place FROM p")
def ml_worst_block(s, d):
    return learn.worst_block_choice(_trials(s, d))


@query(_TRIALS + ", w AS (SELECT block, recall, precision FROM b WHERE config = 'view') SELECT config, bool_and(b.recall >= w.recall AND b.precision >= w.precision)::BIGINT AS safe, round(sum(b.recall - w.recall), 6) AS gain FROM b JOIN w USING (block) GROUP BY config")
def ml_safe_gate(s, d):
    t = _trials(s, d)
    base = t.where("config = 'view'").select("block", F.col("recall").alias("br"), F.col("precision").alias("base_precision"))
    return learn.safe_gate(t.join(base, "block").select("config", F.greatest(F.col("br") - F.col("recall"), F.lit(0.0)).alias("losses"), "precision", "base_precision", (F.col("recall") - F.col("br")).alias("gain")))


@query("WITH p AS (SELECT s_suppkey AS id, s_acctbal / 1e6 AS recall, s_nationkey % 7 AS models, s_suppkey % 13 AS features FROM supplier) SELECT t AS tolerance, arg_min(id, {'m': models, 'f': features, 'r': -recall, 'i': id}) AS id FROM p, (SELECT unnest([0.001, 0.003, 0.005])::DOUBLE AS t) WHERE recall >= (SELECT max(recall) FROM p) - t GROUP BY t")
def ml_smallest_within(s, d):
    return learn.smallest_within(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1e6).alias("recall"), (F.col("s_nationkey") % 7).alias("models"), (F.col("s_suppkey") % 13).alias("features")))


@query()
def ml_pairwise(s, d):
    """Logistic regression without intercept over mirrored pairs of two features; scores of the pool by its weights."""
    x = features.z_gap(labelled(s, d).join(one(s, d, "view").select("qid", "doc_id", "score"), ["qid", "doc_id"], "left").select("qid", "doc_id", "score")).join(labelled(s, d), ["qid", "doc_id"])
    w = learn.fit_logistic(rows.mirrored_pairs(x, rows.base_rank(runs(s, d), FOUR), ("z", "gap")), ("z", "gap"), intercept=False)
    return learn.apply_logistic(x, ("z", "gap"), w).select("qid", "doc_id", F.round("p", 6).alias("p"))


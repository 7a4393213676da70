"""Similarity join, skyline, windows of a reranker, bootstrap, configured rows, products of all pairs: against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import ann, chunking, measure, retrieve, rows, sets, simjoin

# ---------------------------------------------------------------- similarity join


def unit_vectors(seed=3, n=60):
    """Vectors with a term that all share, copies, near copies, and one of common terms alone."""
    r = random.Random(seed)
    out = {}
    for k in range(n):
        terms = {"all": 1.0} | {f"t{r.randint(0, 40)}": r.uniform(0.5, 3) for _ in range(r.randint(1, 6))}
        out[k] = terms
        if k % 5 == 4:
            out[k] = dict(out[k - 1]) | ({"t0": 0.3} if k % 10 == 4 else {})
    out |= {100 + k: dict(out[7]) for k in range(12)} | {200: {"all": 2.0}, 201: {"all": 1.0, "t1": 0.1}}
    norm = {k: math.sqrt(sum(v * v for v in x.values())) for k, x in out.items()}
    return {k: {t: v / norm[k] for t, v in x.items()} for k, x in out.items()}


def cosine(a, b):
    return round(sum(v * b[t] for t, v in a.items() if t in b), 9)


@pytest.fixture(scope="module")
def vectors(spark):
    v = unit_vectors()
    return v, spark.createDataFrame([(k, t, w) for k, x in v.items() for t, w in x.items()], "qid long, term string, weight double").repartition(4).cache()


@pytest.mark.parametrize("least", [0.5, 0.8, 0.92, 0.999])
def test_similarity_join_is_exact(vectors, least):
    v, df = vectors
    links, of = simjoin.similar_pairs(df, least)
    rep = {r.qid: r.rep for r in of.collect()}
    assert all(rep[100 + k] == 7 for k in range(12)) and rep[7] == 7
    got = {(r.a, r.b): round(r.sim, 7) for r in links.collect()}
    reps = sorted(set(rep.values()))
    want = {(a, b): round(cosine(v[a], v[b]), 7) for a in reps for b in reps if a < b and cosine(v[a], v[b]) >= least}
    assert got == want


def test_nearest_similar_equals_plain_join(vectors):
    v, df = vectors
    for least, k in ((0.6, 3), (0.92, 5)):
        got = sorted((r.qid, r.rank, r.other) for r in simjoin.nearest_similar(df, least, k).collect())
        want = []
        for q in v:
            near = sorted(((-cosine(v[q], v[o]), o) for o in v if o != q and cosine(v[q], v[o]) >= least))[:k]
            want += [(q, i + 1, o) for i, (_, o) in enumerate(near)]
        assert got == sorted(want)


def test_common_terms_do_not_meet(vectors):
    v, df = vectors
    n = len(v)
    assert simjoin.candidates(df, 0.92).count() < 0.15 * n * (n - 1) / 2
    assert simjoin.nearest_similar(df.limit(0), 0.9, 3).count() == 0


def test_near_questions_at_the_references_threshold(spark):
    texts = ["the tax on land and water in the north", "the tax on land and water in the north!", "the tax on land and water in the south", "something else entirely"]
    u = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 2)], "qid long, text string")
    from sievecraft.functions import text as X

    got = retrieve.near_questions(u, u.select("qid", (F.col("qid") % 5).alias("fold")), X.char_ngrams(X.tokens(F.col("text"))))
    pairs = {(r.a, r.b) for r in got.collect()}
    assert {(0, 1), (0, 4), (1, 5), (2, 6), (3, 7)} <= pairs and not any({a % 4, b % 4} == {0, 3} for a, b in pairs)


def test_vocabulary(spark):
    p = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "a", 1), (1, "b", 2), (2, "b", 2), (3, "c", 9), (1, "d", 2), (3, "d", 2)], "qid long, term string, tf long")
    of = lambda **how: [(r.term, r.df) for r in retrieve.vocabulary(p, 3, **how).orderBy("term").collect()]
    assert of() == [("a", 3), ("b", 2), ("c", 1), ("d", 2)]
    assert of(least_df=2) == [("a", 3), ("b", 2), ("d", 2)]
    assert of(least_df=2, most_share=0.7) == [("b", 2), ("d", 2)]
    assert of(least_df=2, most_share=0.7, most_terms=1) == [("b", 2)]  # equal numbers go to the smaller term
    assert of(most_terms=2) == [("a", 3), ("c", 1)]


# ---------------------------------------------------------------- skyline


@pytest.mark.parametrize("strict", [None, ("recall", "features"), ("models",)])
def test_skyline_equals_plain_comparison(spark, strict):
    r = random.Random(5)
    points = [(k, r.choice([None, *[x / 10 for x in range(8)]]) if k % 9 == 0 else r.randint(0, 8) / 10, r.randint(1, 6), r.randint(1, 6)) for k in range(150)]
    points += [(1000 + k, *points[3][1:]) for k in range(3)]

    def beats(b, a):
        if None in a[1:] or None in b[1:]:
            return False
        better = {"recall": b[1] > a[1], "models": b[2] < a[2], "features": b[3] < a[3]}
        return b[1] >= a[1] and b[2] <= a[2] and b[3] <= a[3] and any(v for k, v in better.items() if strict is None or k in strict)

    want = {a[0] for a in points if not any(beats(b, a) for b in points)}
    df = spark.createDataFrame(points, "id long, recall double, models int, features int")
    for parts in (1, 7, 40):
        assert {x.id for x in sets.pareto(df.repartition(parts), strict=strict).collect()} == want
    assert sets.pareto(df.limit(0)).count() == 0


# ---------------------------------------------------------------- windows


def test_rerank_windows_equal_plain_loop(spark):
    cases = [(k, n, q) for k, (n, q) in enumerate((n, q) for n in (0, 1, 8, 9, 10, 11, 17, 23, 100) for q in (0, 1, 5, 30))]
    df = spark.createDataFrame([(k, 1, " ".join(f"q{i}" for i in range(q)), " ".join(f"w{i}" for i in range(n))) for k, n, q in cases], "qid long, doc_id long, question string, text string")
    got = defaultdict(list)
    for r in chunking.rerank_windows(df, most=18, most_query=6, overlap=3).orderBy("qid", "window").collect():
        got[r.qid].append((r.start, r.words, r.question))
    for k, n, q in cases:
        words, question = [f"w{i}" for i in range(n)], [f"q{i}" for i in range(q)][:6]
        width = 18 - len(question) - 2
        step, at, want = width - min(3, width // 4), 0, []
        while True:
            if at + width >= n:
                want.append((max(n - width, 0), words[max(n - width, 0) :], question))
                break
            want.append((at, words[at : at + width], question))
            at += step
        assert got[k] == want
    with pytest.raises(Exception, match="no room"):
        chunking.rerank_windows(df, most=5, most_query=6).collect()


def test_windows_are_merged_by_their_best(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.7), (1, 2, 0.7), (1, 3, -1.0)], "qid long, doc_id long, score double")
    assert [tuple(r) for r in chunking.merged_windows(df).orderBy("rank").collect()] == [(1, 1, 0.7, 1), (1, 2, 0.7, 2), (1, 3, 0.0, 3)]


# ---------------------------------------------------------------- bootstrap and rows


@pytest.mark.parametrize("block", [4096, 3])
def test_bootstrap_has_the_moments_of_resampling(spark, block):
    r = random.Random(1)
    d = [r.choice([-1.0, -0.5, 0.0, 0.0, 0.25, 0.5, 1.0, 0.1, 0.2, 0.3]) for _ in range(400)]
    got = measure.bootstrap(spark.createDataFrame([(x,) for x in d] + [(None,)], "delta double"), block=block).head()
    mean, sd = np.mean(d), np.std(d) / math.sqrt(len(d))
    assert got.samples == 20_000 and abs(got.observed - mean) < 1e-12
    assert abs(got.mean - mean) < 5 * sd / math.sqrt(20_000) and abs(got.median - mean) < 0.05 * sd
    assert abs((got.high - got.low) / (2 * 1.96 * sd) - 1) < 0.04
    assert abs(got.p_positive - 0.5 * math.erfc(-mean / sd / math.sqrt(2))) < 0.02


def test_bootstrap_of_two_values_is_binomial(spark):
    """Six queries of which two won: the number of wins drawn is binomial, in one block and in several."""
    df = spark.createDataFrame([(1.0,)] * 2 + [(0.0,)] * 4, "delta double")
    for block in (4096, 1):
        got = measure.bootstrap(df, block=block).head()
        assert abs(got.p_positive - (1 - (4 / 6) ** 6)) < 0.015
    assert measure.bootstrap(df, block=1).collect() == measure.bootstrap(df.repartition(3), block=1).collect()


def test_configured_rows(spark):
    pool = spark.createDataFrame([(1, 1), (1, 2)], "qid long, doc_id long")
    runs = spark.createDataFrame([(1, "a", 1, 1, 2.0), (1, "b", 2, 3, 5.0)], "qid long, branch string, doc_id long, rank int, score double")
    meta = {"m": spark.createDataFrame([(1, 7)], "doc_id long, x long")}
    build = lambda c: rows.configured_rows(c, pool, runs, runs, meta)
    assert build({"rank_views": ["a"]}).columns == ["qid", "doc_id", "rr_a", "r_a", "least_rank", "mean_rank"]
    assert build({"score_channels": ["b", "a"]}).columns == ["qid", "doc_id", "z_b", "gap_b", "z_a", "gap_a"]
    assert [tuple(r) for r in build({"metadata": ["m"]}).orderBy("doc_id").collect()] == [(1, 1, 7), (1, 2, 0)]
    for bad in ({}, {"metadata": ["n"]}):
        with pytest.raises(ValueError):
            build(bad)


@pytest.mark.parametrize("block", [4096, 7])
def test_products_of_all_pairs(spark, block):
    r = np.random.default_rng(2)
    x = r.normal(size=(40, 5)).astype(np.float32)
    x[10:20] = x[10]
    df = spark.createDataFrame([(100 - k, [float(a) for a in v]) for k, v in enumerate(x)] + [(500, None)], "vec_id long, embedding array<float>")
    got = {(g.qid, g.rank): g.other for g in ann.all_pairs_top(df, 4, block).collect()}
    s = np.rint((x.astype(float) @ x.astype(float).T + 1e-10) * 1e6)
    for q in range(40):
        near = sorted(((-s[q, o], 100 - o) for o in range(40) if o != q))[:4]
        assert [got[100 - q, k + 1] for k in range(4)] == [o for _, o in near]
    assert Counter(q for q, _ in got) == Counter({100 - k: 4 for k in range(40)})

"""Inverted file of vectors and listwise boosted trees, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievecraft.operators import ann, ltr

# ---------------------------------------------------------------- vectors


def clustered(n, dim=16, seed=3, hot=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim)) * 3
    x = (centres[r.integers(0, 12, n)] + r.normal(size=(n, dim))).astype(np.float32)
    x[:hot] = x[0]  # one vector many times over
    return x


def table_of(spark, x, extra=()):
    return spark.createDataFrame([*((k, [float(a) for a in v]) for k, v in enumerate(x)), *extra], "vec_id long, embedding array<float>")


def brute(x, qid, k):
    d = np.rint(np.sqrt(((x.astype(float) - x[qid].astype(float)) ** 2).sum(1)) * 1e6).astype(np.int64)
    return [int(j) for j in np.lexsort((np.arange(len(x)), d)) if j != qid][:k]


def asked(df, step=10):
    return df.where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@pytest.mark.parametrize("hot", [0, 700])
def test_recall_reaches_what_is_wanted(spark, hot, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 128)
    x = clustered(2000, hot=hot)
    df = table_of(spark, x, [(5000, None), (5001, [1.0, 2.0])]).repartition(6)
    got = ann.neighbours(df, asked(df), 10).collect()
    found = {}
    for r in got:
        found.setdefault(r.qid, []).append((r.rank, r.vec_id, r.dist))
    qids = range(0, 2000, 10)
    hits = sum(len({v for _, v, _ in found[q]} & set(brute(x, q, 10))) for q in qids)
    assert hits >= 0.9 * 10 * len(qids)
    assert got[0].recall >= 0.88 and got[0].probes <= got[0].cells
    assert all([n for n, _, _ in sorted(found[q])] == list(range(1, 11)) for q in qids)
    for q in (0, 500):
        for _, v, d in found[q]:
            assert abs(d - math.dist(x[q].astype(float), x[v].astype(float))) < 1e-5


def test_all_cells_probed_is_exact(spark):
    x = clustered(600, hot=200)
    df = table_of(spark, x)
    index = ann.build(df, block=64)
    got = ann.search(index, asked(df, 50), 6, probes=10**6, block=3).where("qid <> vec_id")
    for q in range(0, 600, 50):
        assert [r.vec_id for r in got.where(f"qid = {q}").orderBy("rank").collect()][:5] == brute(x, q, 5)


def test_fewer_pairs_meet_than_all(spark):
    """Close clusters of their own cells: a probe reaches the neighbours, so most of the table is never met."""
    x = clustered(3000)
    index = ann.build(table_of(spark, x))
    probes, recall = ann.probes_for(index, 10)
    assert recall >= 0.9 and probes <= 0.35 * len(index.centroids)


def test_odd_vectors(spark):
    assert ann.neighbours(table_of(spark, []), asked(table_of(spark, []))).count() == 0
    same = table_of(spark, np.ones((50, 4), np.float32))
    got = ann.neighbours(same, asked(same, 25), 3).orderBy("qid", "rank").collect()
    assert [(r.qid, r.vec_id, r.dist) for r in got] == [(0, 1, 0.0), (0, 2, 0.0), (0, 3, 0.0), (25, 0, 0.0), (25, 1, 0.0), (25, 2, 0.0)]


def test_query_asks_with_every_hundredth_and_reports_its_recall(spark):
    import pyarrow.parquet as pq

    from sievecraft.plans import registry

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pydict()
    ids, x = t["vec_id"], np.array(t["embedding"], np.float32)
    got = registry.QUERIES["ret_lsh_ann"](spark, "/root/testdata/sf0.01").collect()
    assert {r.qid for r in got} == {i for i in ids if i % 100 == 0}
    hits = sum(r.vec_id in {ids[j] for j in brute(x, ids.index(r.qid), 10)} for r in got)
    assert hits >= 0.9 * len(got) and got[0].recall >= 0.9


def test_sample_is_fine_enough(spark):
    df = spark.range(5000).withColumnRenamed("id", "vec_id")
    assert 20 < ann.sampled(df, "vec_id", 50, 5000).count() < 100
    assert ann.sampled(df, "vec_id", 6000, 5000).count() == 5000
    assert ann.sampled(df, "vec_id", 20_000, 10**15).count() == 0  # a share of 2e-11 is a share, not a rounding to nothing


# ---------------------------------------------------------------- rankers


def toy(queries=60, seed=5):
    """Within a query the label follows a - b, and a query's documents are all shifted by a number of its own."""
    r = random.Random(seed)
    rows = []
    for q in range(queries):
        shift = r.uniform(-20, 20)
        for doc in range(r.randint(2, 12)):
            a, b, c = r.random(), r.random(), r.random()
            y = 2 if a - b > 0.4 else 1 if a - b > 0.1 else 0
            rows.append((q, doc, float(y), a + shift, b + shift, c if doc % 5 else None, a - b + r.gauss(0, 0.1), q % 4))
    return rows


COLUMNS = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(toy(), "qid long, doc_id long, y double, a double, b double, c double, d double, block int").repartition(5)


def plain_gradients(y, s):
    order = sorted(range(len(y)), key=lambda i: (-s[i], i))
    place = {i: p for p, i in enumerate(order)}
    ideal = sum((2**v - 1) / math.log2(p + 2) for p, v in enumerate(sorted(y, reverse=True)))
    g, h = [0.0] * len(y), [0.0] * len(y)
    for i in range(len(y)):
        for j in range(len(y)):
            if y[i] > y[j]:
                swap = abs(2 ** y[i] - 2 ** y[j]) * abs(1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2)) / ideal
                rho = 1 / (1 + math.exp(s[i] - s[j]))
                g[i] -= swap * rho
                g[j] += swap * rho
                h[i] += swap * rho * (1 - rho)
                h[j] += swap * rho * (1 - rho)
    return g, h


def test_gradients_equal_plain_ones():
    r = random.Random(2)
    for _ in range(50):
        n = r.randint(1, 9)
        y, s = [r.randint(0, 3) for _ in range(n)], [r.choice([0.0, r.gauss(0, 2)]) for _ in range(n)]
        g, h = ltr.swap_gradients(np.array(y, float), np.array(s))
        pg, ph = plain_gradients(y, s) if any(y) else ([0.0] * n, [0.0] * n)
        assert np.allclose(g, pg) and np.allclose(h, ph)
    g, _ = ltr.swap_gradients(np.array([0.0, 1.0, 2.0]), np.array([3.0, 2.0, 1.0]), depth=1)
    assert g[0] > 0 and g[1] < 0 and g[2] < 0


def plain_fit(rows, edges, trees, depth, rate, ridge, least):
    """One model over all rows, level by level, row by row."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    x = [[sum(e < (v or 0.0) for e in edge) for v, edge in zip(r[3:7], edges)] for r in rows]
    score, groups, model = [0.0] * len(rows), {}, []
    for k, r in enumerate(rows):
        groups.setdefault(r[0], []).append(k)
    for _ in range(trees):
        g, h = [0.0] * len(rows), [0.0] * len(rows)
        for ks in groups.values():
            y = [rows[k][2] for k in ks]
            if len(set(y)) > 1:
                for k, a, b in zip(ks, *plain_gradients(y, [score[k] for k in ks])):
                    g[k], h[k] = a, b
        at, splits = [0] * len(rows), {}
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                mine, best = [k for k in range(len(rows)) if at[k] == node], (1e-12, None)
                for f in range(4):
                    for b in range(32):
                        left, right = [k for k in mine if x[k][f] <= b], [k for k in mine if x[k][f] > b]
                        gl, hl, gr, hr = (sum(v[k] for k in side) for side in (left, right) for v in (g, h))
                        if hl >= least and hr >= least:
                            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gl + gr) ** 2 / (hl + hr + ridge)
                            if gain > best[0] * (1 + 1e-11):
                                best = gain, (f, b)
                splits[node] = best[1]
            at = [2 * a + 1 + (splits[a] is not None and x[k][splits[a][0]] > splits[a][1]) for k, a in enumerate(at)]
        value = {leaf: -rate * sum(g[k] for k in range(len(rows)) if at[k] == leaf) / (sum(h[k] for k in range(len(rows)) if at[k] == leaf) + ridge) for leaf in set(at)}
        score = [s + value[a] for s, a in zip(score, at)]
        model.append(splits)
    return {(r[0], r[1]): s for r, s in zip(rows, score)}, model


def test_ranker_equals_plain_version(frame, monkeypatch):
    monkeypatch.setattr(ltr, "KEEP", 2)
    how = dict(trees=5, depth=2, rate=0.3, ridge=1.0, least=1e-3)
    model = ltr.fit_rankers(frame, COLUMNS, [-1], "block", **how)
    got = {(r.qid, r.doc_id): r.score for r in ltr.apply_rankers(frame, model).collect()}
    want, splits = plain_fit(toy(), model[-1].edges, **how)
    for tree, plain in zip(model[-1].trees, splits):
        for node, s in plain.items():
            assert s is None or (tree.feature[node], tree.cut[node]) == s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def ndcg(rows, score, k=10):
    out = []
    for q in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-score[r[0], r[1]], r[1]))
        gain = lambda rs: sum((2 ** r[2] - 1) / math.log2(i + 2) for i, r in enumerate(rs[:k]))
        best = gain(sorted(mine, key=lambda r: -r[2]))
        if best:
            out.append(gain(mine) / best)
    return sum(out) / len(out)


def test_beats_pointwise_trees_by_blocks_left_out(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = toy(160, 9)
    df = spark.createDataFrame([(*r[:5], r[5] or 0.0, *r[6:]) for r in rows], "qid long, doc_id long, y double, a double, b double, c double, d double, block int")
    listwise = {(r.qid, r.doc_id): r.score for r in ltr.left_out_scores(df, ("a", "b", "c", "d"), "block", trees=15, depth=3).collect()}
    x = VectorAssembler(inputCols=list(COLUMNS), outputCol="x").transform(df).withColumn("label", (F.col("y") > 0).cast("double"))
    pointwise = {}
    for fold in range(4):
        m = GBTClassifier(featuresCol="x", labelCol="label", maxIter=5, maxDepth=3, seed=7).fit(x.where(F.col("block") != fold))
        pointwise |= {(r.qid, r.doc_id): r.p for r in m.transform(x.where(F.col("block") == fold)).select("qid", "doc_id", vector_to_array("probability")[1].alias("p")).collect()}
    a, b = ndcg(rows, listwise), ndcg(rows, pointwise)
    assert a > b and a > 0.9, (a, b)


def test_a_block_is_not_learned_from(spark):
    """Labels of one block turned upside down leave the scores of that block as they are."""
    rows = toy(40, 4)
    schema = "qid long, doc_id long, y double, a double, b double, c double, d double, block int"
    turned = [(*r[:2], 2 - r[2], *r[3:]) if r[7] == 1 else r for r in rows]
    one, other = ({(r.qid, r.doc_id): r.score for r in ltr.left_out_scores(spark.createDataFrame(x, schema), COLUMNS, "block", trees=3, depth=2).where("qid % 4 = 1").collect()} for x in (rows, turned))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-9 for k in one)


def test_rankers_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.5, 0), (1, 2, 0.0, None, 0), (2, 1, 1.0, 0.1, 1)], "qid long, doc_id long, y double, a double, block int")
    got = ltr.left_out_scores(df, ("a",), "block", trees=2, depth=2).collect()
    assert Counter((r.qid, r.doc_id, r.score) for r in got) == Counter([(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0)])

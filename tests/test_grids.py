"""Sweeps against plain loops over a few configurations."""

import math
import random
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from sievecraft.operators import grids


def listed(scores, most=100):
    return [d for d, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))][:most]


def measured(order, gold):
    five = sum(d in gold for d in order[:5])
    gain = sum(1 / math.log2(i + 2) for i, d in enumerate(order[:10]) if d in gold)
    return five / len(gold), five / 5, gain / sum(1 / math.log2(i + 2) for i in range(min(10, len(gold))))


def blended(a, b, alpha, k):
    ra, rb = ({d: i + 1 for i, d in enumerate(x)} for x in (a, b))
    return listed({d: alpha / (k + ra.get(d, 100_000)) + (1 - alpha) / (k + rb.get(d, 100_000)) for d in {*a, *b}})


@pytest.fixture(scope="module")
def world():
    r = random.Random(4)
    gold = {q: set(r.sample(range(25), r.randint(1, 4))) for q in range(14)}
    base = {q: r.sample(range(25), r.randint(3, 15)) for q in range(13)}  # one query has no ranking
    base[99] = [1, 2, 3]  # and one no answer
    return gold, base


def frames(spark, gold, base):
    g = spark.createDataFrame([(q, d) for q, ds in gold.items() for d in ds], "qid long, doc_id long")
    return g, spark.createDataFrame([(q, d, i + 1) for q, ds in base.items() for i, d in enumerate(ds)], "qid long, doc_id long, rank int")


def check(got, want, columns):
    found = {tuple(r[c] for c in columns): (r.n, r.recall5, r.precision5, r.ndcg10) for r in got.collect()}
    assert found.keys() == want.keys()
    for c, (n, *m) in want.items():
        assert found[c][0] == n and np.allclose(found[c][1:], m, atol=1e-9), c


def average(per, n):
    return (n, *[sum(x[j] for x in per) / n for j in range(3)])


def test_graph(spark, world):
    gold, base = world
    grid = {"seeds": (1, 4), "power": (0.5, 2.0), "mode": ("conditional", "cosine", "jaccard", "lift"), "min_edge": (1, 2), "alpha": (0.1, 1.5), "base_k": (0, 20)}
    n, e = defaultdict(int), defaultdict(int)
    for ds in gold.values():
        for a in ds:
            n[a] += 1
            for b in ds - {a}:
                e[a, b] += 1
    g, ranking = frames(spark, gold, base)
    edges = spark.createDataFrame([(a, b, c) for (a, b), c in e.items()], "src long, dst long, cnt long")
    freq = spark.createDataFrame(list(n.items()), "doc_id long, n long")
    how = {"conditional": lambda c, x, y: c / (x + 1), "cosine": lambda c, x, y: c / math.sqrt((x + 0.5) * (y + 0.5)), "jaccard": lambda c, x, y: c / (x + y - c + 1), "lift": lambda c, x, y: c / ((x + 0.5) * (y + 0.5)) ** 0.35}
    want = {}
    for seeds, power, mode, least, alpha, k in product(*grid.values()):
        per = []
        for q, answers in gold.items():
            s, place = defaultdict(float), {d: i + 1 for i, d in enumerate(base.get(q, []))}
            for d, i in place.items():
                if i <= seeds:
                    for (a, b), c in e.items():
                        if a == d and c >= least:
                            s[b] += how[mode](c, n[a], n[b]) / i**power
            top = max(s.values(), default=0) or 1
            per.append(measured(listed({d: 1 / (k + place.get(d, 100_000)) + alpha * s.get(d, 0) / top / (k + 1) for d in {*place, *s}}), answers))
        want[seeds, power, mode, least, alpha, k] = average(per, len(gold))
    check(grids.graph_grid(ranking, edges, freq, g, grid), want, list(grid))


def test_kernel(spark, world):
    gold, base = world
    r = random.Random(6)
    grid = {"power": (1.0, 3.0), "word": (0.0, 0.75), "prior": (-0.35, 0.0, 0.35), "alpha": (0.2, 1.0), "k": (0, 20)}
    labels = {o: set(r.sample(range(25), r.randint(1, 3))) for o in range(100, 130)}
    sims = [{(q, o): round(r.random(), 3) for q in range(14) for o in labels if r.random() < 0.4} for _ in range(2)]
    g, ranking = frames(spark, gold, base)
    channel = [spark.createDataFrame([(q, o, s) for (q, o), s in x.items()], "qid long, other long, sim double") for x in sims]
    lab = spark.createDataFrame([(o, d) for o, ds in labels.items() for d in ds], "qid long, doc_id long")
    freq = defaultdict(int)
    for ds in labels.values():
        for d in ds:
            freq[d] += 1
    most, depth, want = max(freq.values()), 8, {}
    for power, mix, pp, alpha, k in product(*grid.values()):
        per = []
        for q, answers in gold.items():
            held = []
            for x in sims:
                near = sorted(((s, o) for (a, o), s in x.items() if a == q), key=lambda v: (-v[0], v[1]))[:depth]
                ev = defaultdict(list)
                for s, o in near:
                    for d in labels[o]:
                        ev[d].append(s**power)
                ev = {d: sum(a * b for a, b in zip(v, (1, 0.4, 0.15))) for d, v in ev.items()}
                top = max(ev.values(), default=1)
                held.append({d: v / top for d, v in ev.items()})
            s = {d: (mix * held[0].get(d, 0) + (1 - mix) * held[1].get(d, 0)) * ((freq[d] + 0.5) / (most + 0.5)) ** pp for d in {*held[0], *held[1]}}
            per.append(measured(blended(listed(s), base.get(q, []), alpha, k), answers))
        want[power, mix, pp, alpha, k] = average(per, len(gold))
    check(grids.kernel_grid(*channel, lab, ranking, g, grid, depth), want, list(grid))


def test_profile(spark, world):
    gold, base = world
    r = random.Random(8)
    grid = {"ngram": (1, 3), "k1": (0.5, 2.5), "b": (0.25, 1.0), "prior": (-0.3, 0.3), "alpha": (0.1, 1.0), "k": (0, 40)}
    feats = [f"{n}:{w}" for n in (1, 2, 3) for w in "abcdefg"]
    asked = {q: set(r.sample(feats, r.randint(1, 9))) for q in range(14)}
    support = {(q, d): set(r.sample(feats, 6)) for q in range(100, 120) for d in r.sample(range(25), 2)}
    tf, dl, lf = defaultdict(lambda: defaultdict(int)), defaultdict(int), defaultdict(int)
    for (_, d), fs in support.items():
        lf[d] += 1
        for f in fs:
            tf[f][d] += 1
            dl[d] += 1
    mean, n, most, want = sum(dl.values()) / len(dl), len(dl), max(lf.values()), {}
    for width, k1, b, pp, alpha, k in product(*grid.values()):
        per = []
        for q, answers in gold.items():
            s = defaultdict(float)
            for f in asked[q]:
                if int(f[0]) <= width:
                    for d, t in tf[f].items():
                        s[d] += (1, 1.35, 1.65)[int(f[0]) - 1] * math.log1p((n - len(tf[f]) + 0.5) / (len(tf[f]) + 0.5)) * t * (k1 + 1) / (t + k1 * (1 - b + b * dl[d] / mean))
            s = {d: v * ((lf[d] + 0.5) / (most + 0.5)) ** pp for d, v in s.items()}
            per.append(measured(blended(listed(s), base.get(q, []), alpha, k), answers))
        want[width, k1, b, pp, alpha, k] = average(per, len(gold))
    g, ranking = frames(spark, gold, base)
    a = spark.createDataFrame([(q, f) for q, fs in asked.items() for f in fs], "qid long, feature string")
    sup = spark.createDataFrame([(q, d, f) for (q, d), fs in support.items() for f in fs], "qid long, doc_id long, feature string")
    check(grids.profile_grid(a, sup, ranking, g, grid), want, list(grid))


def test_whole_grid_and_empty_tables(spark, world):
    gold, base = world
    g, ranking = frames(spark, gold, base)
    none = spark.createDataFrame([], "src long, dst long, cnt long")
    freq = spark.createDataFrame([], "doc_id long, n long")
    out = grids.graph_grid(ranking, none, freq, g)
    assert out.count() == 13_824 and out.select("n").distinct().collect()[0][0] == len(gold)
    best = grids.best_trials(out, 5).collect()
    assert [r.place for r in best] == [1, 2, 3, 4, 5] and best[0].seeds == 1
    assert grids.graph_grid(ranking, none, freq, g.limit(0)).count() == 0


def test_places_of_ties_and_missing():
    s = np.array([[0.5, -np.inf, 0.5, 0.1], [-np.inf] * 4, [0.1 + 1e-12, 0.1, 0.2, 0.3]])
    assert grids.places(s, 3).tolist() == [[0, 2, 3], [-1, -1, -1], [3, 2, 0]]

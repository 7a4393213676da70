"""Findings of round 4: phrases without an index of all of them, a sweep of the graph that does not sort."""

import random

import numpy as np
import pytest

from sievecraft.operators import grids, index, passing
from sievecraft.plans import registry
from tests.test_index import PHRASES, QUESTIONS, asked, drawn, plain, same
from tests.test_round3 import both, folder  # noqa: F401 (a fixture)

FAR = QUESTIONS | {5: ["law tax", "the"], 6: ["of the law"]}  # terms of another number of words are in no text


@pytest.fixture(scope="module")
def rows():
    return drawn(60, 12)


def listed(found, grain):
    return [tuple(x) for x in found.select("qid", "doc_id", *(["no"] if grain == "chunk" else []), "score", "rank").collect()]


@pytest.mark.parametrize("at_once", [1_000_000, 3])
@pytest.mark.parametrize("grain", ["doc", "chunk"])
def test_a_pass_equals_plain_bm25(spark, rows, grain, at_once, monkeypatch):
    monkeypatch.setattr(passing, "PASS_ROWS", at_once)  # in one block, in several
    monkeypatch.setattr(passing, "PACK", 7)
    docs = spark.createDataFrame([*rows, (None, "law tax the of the")], "doc_id long, text string").repartition(3)
    got = passing.bm25(docs, [(1, asked(spark, FAR)), (3, asked(spark, PHRASES | {6: ["law", "of the law"]}))], [(0, 20, grain), (1, 5, grain), (1, 100, grain)])
    for found, width, queries, k in zip(got, (1, 3, 3), (FAR, *[PHRASES | {6: ["law", "of the law"]}] * 2), (20, 5, 100)):
        fitting = {q: [t for t in ts if len(t.split()) == width] for q, ts in queries.items()}
        same(listed(found, grain), plain(rows, fitting, k, width, grain))


def test_a_pass_over_nothing_and_over_ids_that_repeat(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert listed(passing.bm25(none, [(3, asked(spark, PHRASES))], [(0, 5, "doc")])[0], "doc") == []
    some = spark.createDataFrame([("a", "law tax"), ("b", "law")], "doc_id string, text string")
    assert listed(passing.bm25(some, [(1, asked(spark, {1: ["nothing"]}))], [(0, 5, "doc")])[0], "doc") == []
    assert {x[1] for x in listed(passing.bm25(some, [(1, asked(spark, QUESTIONS))], [(0, 5, "doc")])[0], "doc")} == {"a", "b"}
    twice = spark.createDataFrame([(1, "law tax"), (1, "law"), (2, "tax")], "doc_id long, text string")
    twice.write.parquet(f"{tmp_path}/t")
    twice = spark.read.parquet(f"{tmp_path}/t")
    same(listed(passing.bm25(twice, [(1, asked(spark, QUESTIONS))], [(0, 5, "doc")])[0], "doc"), listed(index.bm25(index.stored(twice), asked(spark, QUESTIONS), 5), "doc"))


def test_phrases_are_not_all_stored(spark, tmp_path, monkeypatch):
    """No index of word runs, whose size is several times the text's."""
    monkeypatch.setattr(index, "stored", lambda docs, width=1: pytest.fail("an index of all runs") if width > 1 else None)
    assert registry.QUERIES["ret_bm25_phrase"](spark, "/root/testdata/sf0.001").count() > 0


def test_bundle_stores_no_postings_of_documents(spark, folder, monkeypatch):  # noqa: F811
    read, stored = [], index.stored
    monkeypatch.setattr(index, "stored", lambda docs, width=1: read.extend(docs.inputFiles()) or stored(docs, width))
    got, want = both(spark, folder, "ret_bundle")
    assert got == want and {x[1] for x in got} == {"full", "local", "trigram", "memory"}
    assert read and all("/benchmark.parquet" in x for x in read)


@pytest.mark.parametrize("n, share, most", [(5, 0.5, 1), (30, 0.3, 3), (89, 1.0, 40), (300, 0.02, 4)])
def test_graph_sweep_counts_what_sorting_finds(n, share, most, monkeypatch):
    """All configurations, on queries with ties, without links, and with answers that nothing reaches; the grid at once and in parts."""
    monkeypatch.setattr(grids, "CELLS", {5: 100, 30: 2000}.get(n, grids.CELLS))
    r, grid = random.Random(n), grids.GRAPH_GRID
    docs = sorted(r.sample(range(1000), n))
    edges = [(a, b, r.randint(1, most)) for a in docs for b in docs if a != b and r.random() < share]
    freq = {d: r.choice([most, 2 * most]) for d in docs}
    column = lambda f: np.array([float(f(x)) for x in edges])
    links = grids.Links.of([x[0] for x in edges], [x[1] for x in edges], column(lambda x: x[2]), column(lambda x: freq[x[0]]), column(lambda x: freq[x[1]]), grid["mode"])
    for size in (0, 1, min(n, 40)):
        base = r.sample(docs, size) + [1001] * (size > 1)
        gold = [*r.sample(docs, 3), *base[:1], 2000]
        place = {d: i + 1 for i, d in enumerate(base)}
        mine = [x for x in edges if place.get(x[0], 99) <= max(grid["seeds"])]
        every = sorted({*base, *[x[1] for x in mine]})
        at, want = {d: i for i, d in enumerate(every)}, []
        rank, count = np.array([place[x[0]] for x in mine], float), np.array([x[2] for x in mine], float)
        dst, (left, right) = np.array([at[x[1]] for x in mine], int), (np.array([freq[x[c]] for x in mine], float) for c in (0, 1))
        own = np.array([place.get(d, grids.MISSING) for d in every], float)
        for seeds, power, mode, least in grids.product(*[grid[c] for c in ("seeds", "power", "mode", "min_edge")]):
            ok = (rank <= seeds) & (count >= least)
            g = np.bincount(dst[ok], (grids.strength(mode, count, left, right) / rank**power)[ok], len(every))
            here = (np.bincount(dst[ok], minlength=len(every)) > 0) | (own < grids.MISSING)
            s = [np.where(here, 1 / (k + own) + a * (g / (g.max(initial=0) or 1)) / (k + 1), -np.inf) for a in grid["alpha"] for k in grid["base_k"]]
            want.append(grids.measures(np.array(s), np.isin(every, gold), len({*gold})) if every else np.zeros((len(s), 3)))
        row = [{"rank": place[x[0]], "dst": x[1], "cnt": x[2], "fs": freq[x[0]], "fd": freq[x[1]]} for x in mine]
        for found in (links.first(base, max(grid["seeds"])), grids._of_row(row, grid["mode"])):
            got = grids._graph_judged(base, gold, grid, *found)
            assert np.allclose(0 if got is None else got, np.concatenate(want), atol=1e-9)


def test_graph_sweep_brings_links_only_if_they_are_many(spark, monkeypatch):
    g = spark.createDataFrame([(q, d) for q in range(40) for d in {q % 5, q % 7, q % 3 + 4}], "qid long, doc_id long")
    ranking = spark.createDataFrame([(q, (q + 3 * i) % 9, i + 1) for q in range(40) for i in range(5)], "qid long, doc_id long, rank int")
    edges = spark.createDataFrame([(a, b, a + b) for a in range(9) for b in range(7) if a != b], "src long, dst long, cnt long")
    freq = spark.createDataFrame([(d, 20 + d) for d in range(9)], "doc_id long, n long")
    grid, seen, swept = {"seeds": (1, 3), "power": (0.5,), "mode": ("cosine", "lift"), "min_edge": (1, 4), "alpha": (0.1, 1.0), "base_k": (0, 20)}, [], grids.swept
    monkeypatch.setattr(grids, "swept", lambda rows, *a, **b: seen.append((rows.columns, rows.rdd.getNumPartitions())) or swept(rows, *a, **b))
    found = []
    for most in (500_000, 0):
        monkeypatch.setattr(grids, "GRAPH_LINKS", most)
        found.append(sorted(map(tuple, grids.graph_grid(ranking, edges, freq, g, grid).collect())))
    assert len(found[0]) == 32 and np.allclose([x[4:] for x in found[0]], [x[4:] for x in found[1]]) and any(x[7] for x in found[0])
    assert [x[0] for x in seen] == [["qid", "base", "gold"], ["qid", "base", "gold", "links"]]
    assert seen[0][1] >= 4 * spark.sparkContext.defaultParallelism  # small rows, much work


@pytest.mark.parametrize("grain", ["doc", "chunk"])
def test_of_many_tasks_few_hand_on_all_their_best(spark, grain, monkeypatch):
    rows, handed = drawn(400, 21), []
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(25)
    one_pass = passing._one_pass
    monkeypatch.setattr(passing, "_one_pass", lambda *a: handed.append(one_pass(*a)) or handed[-1])
    for few in (16, 1000):
        monkeypatch.setattr(passing, "FEW_TASKS", few)
        got = passing.bm25(docs, [(1, asked(spark, QUESTIONS))], [(0, 6, grain), (0, 2000, grain)])
        for found, k in zip(got, (6, 2000)):
            same(listed(found, grain), plain(rows, QUESTIONS, k, 1, grain))
    assert handed[0][0].count() < 0.6 * handed[1][0].count()

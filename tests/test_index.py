"""The stored inverted index against plain BM25, appended to, opened again, and under other join strategies."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import index
from sievecraft.sources import readers

WORDS = "the of law tax land court fine water north river appeal notice order form Über đất thuế".split()


def drawn(n, seed, first=0):
    r = random.Random(seed)
    out = [(first + k, " ".join(r.choices(WORDS, [9, 7, *[1] * (len(WORDS) - 2)], k=r.choice([0, 1, 2, 3, 30, 99, 101, 102, 499, 500, 501, 900, 1300])))) for k in range(n)]
    return [*out, (first + n, None), (first + n + 1, ""), (first + n + 2, "...")]


def plain(rows, queries, k, width, grain):
    units = {}
    for doc_id, text in rows:
        w = re.findall(r"\w+", (text or "").lower())
        if grain == "doc":
            units[doc_id,] = w
        else:
            for no, at in enumerate(range(0, max(0, len(w) - 101) + 1, 400)):
                units[doc_id, no] = w[at : at + 500]
    units = {u: [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] for u, w in units.items()}
    n, mean = len(units), sum(map(len, units.values())) / len(units)
    df = Counter(t for w in units.values() for t in set(w))
    out = []
    for qid, terms in queries.items():
        scores = defaultdict(float)
        for u, w in units.items():
            tf = Counter(w)
            for t in set(terms):
                if tf[t]:
                    idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                    scores[u] += (idf if idf > 0 else 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(qid, *u, s, i + 1) for i, (u, s) in enumerate(best)]
    return out


QUESTIONS = {1: ["law", "tax", "the"], 2: ["đất", "thuế"], 3: ["nothing"], 4: ["river", "river", "fine"]}
PHRASES = {1: ["the of the", "law tax land"], 2: ["of the of"], 3: ["no such phrase"]}


def asked(spark, queries):
    return spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "qid long, term string")


def got(ix, queries, k, grain):
    r = index.bm25(ix, asked(ix.spark, queries), k, grain)
    return [tuple(x) for x in r.select("qid", "doc_id", *(["no"] if grain == "chunk" else []), "score", "rank").collect()]


def same(a, b):
    """Same units in the same places; scores are sums whose last digits depend on their order."""
    a, b = sorted(a), sorted(b)
    assert [(*x[:-2], x[-1]) for x in a] == [(*x[:-2], x[-1]) for x in b]
    assert all(abs(x[-2] - y[-2]) < 2e-9 for x, y in zip(a, b))


@pytest.fixture(scope="module")
def rows():
    return drawn(40, 3)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("width, queries", [(1, QUESTIONS), (3, PHRASES)])
@pytest.mark.parametrize("grain", ["doc", "chunk"])
def test_equals_plain_bm25(df, rows, width, queries, grain, tmp_path):
    ix = index.build(df.repartition(5), str(tmp_path / "ix"), width, segment_chars=20_000)
    assert ix.segments > 1
    for k in (5, 100):
        same(got(ix, queries, k, grain), plain(rows, queries, k, width, grain))


def test_large_query_sets_deal_hot_terms(df, rows, tmp_path, monkeypatch):
    ix = index.build(df, str(tmp_path / "ix"))
    want = plain(rows, QUESTIONS, 50, 1, "chunk")
    for few, many, share in ((0, 300_000, 0.001), (0, 0, 0.001), (0, 0, 0.2), (256, 0, 0.05)):
        monkeypatch.setattr(index, "FEW_TERMS", few)
        monkeypatch.setattr(index, "ASKED_ROWS", many)
        monkeypatch.setattr(index, "HOT_SHARE", share)
        same(got(ix, QUESTIONS, 50, "chunk"), want)


def test_append_equals_a_new_index(spark, df, rows, tmp_path):
    more = drawn(25, 8, 1000)
    ix = index.build(df, str(tmp_path / "ix"))
    both = df.unionByName(spark.createDataFrame(more, df.schema))
    ix = index.append(ix, both)  # what it holds already is left out
    assert ix.segments == 2
    for grain in ("doc", "chunk"):
        same(got(ix, QUESTIONS, 30, grain), plain(rows + more, QUESTIONS, 30, 1, grain))
    assert index.append(ix, both).totals == ix.totals


def test_an_unfinished_append_is_not_seen(spark, df, rows, tmp_path):
    ix = index.build(df, str(tmp_path / "ix"))
    left = ix.postings.limit(50).withColumn("segment", F.lit(ix.segments)).withColumn("doc_id", F.col("doc_id") + 10**6)
    left.write.mode("append").partitionBy("segment", "bucket").parquet(f"{ix.folder}/postings")
    again = index.open_index(spark, ix.folder)
    same(got(again, QUESTIONS, 30, "doc"), plain(rows, QUESTIONS, 30, 1, "doc"))


def test_stored_index_is_opened_until_the_table_changes(spark, rows, tmp_path, monkeypatch):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    first = index.stored(spark.read.parquet(path))
    monkeypatch.setattr(index, "build", lambda *a, **b: pytest.fail("built again"))
    second = index.stored(spark.read.parquet(path))
    assert second.folder == first.folder and second.totals == first.totals
    monkeypatch.undo()
    spark.createDataFrame(drawn(2, 1, 5000), "doc_id long, text string").write.mode("append").parquet(path)
    third = index.stored(spark.read.parquet(path))
    assert third.folder != first.folder and third.totals["docs"] == first.totals["docs"] + 5
    with pytest.raises(ValueError):
        index.build(spark.read.parquet(path), third.folder)


def test_signature_of_rows_and_files(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string"), spark.createDataFrame([(2, "y"), (1, "x")], "id long, t string")
    assert readers.signature_of(a) == readers.signature_of(b) != readers.signature_of(a.limit(1))
    a.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert readers.signature_of(read) == readers.signature_of(read.select("id"))


def test_empty_table_and_missing_ids(spark, tmp_path):
    none = index.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert got(none, QUESTIONS, 5, "doc") == []
    odd = index.build(spark.createDataFrame([(None, "law"), (7, "law tax")], "doc_id long, text string"), str(tmp_path / "odd"))
    assert [x[1] for x in got(odd, QUESTIONS, 5, "chunk")] == [7]


def test_text_ids(spark, tmp_path):
    ix = index.build(spark.createDataFrame([("a", "law tax"), ("b", "law")], "doc_id string, text string"), str(tmp_path / "ix"))
    assert {x[1] for x in got(ix, QUESTIONS, 5, "doc")} == {"a", "b"}


def test_phrases_keep_content_words(spark):
    df = spark.createDataFrame([("là của luật đất đai",)], "t string")
    assert df.select(X.phrases(X.tokens(F.col("t")), 3)).head()[0] == ["của luật đất", "luật đất đai"]

"""Payload checks, key patterns and row upserts."""

import pytest

from sievecraft.sources import readers, sinks


def test_checked_runs(spark):
    of = lambda *payloads: spark.createDataFrame([(str(k), "s", p) for k, p in enumerate(payloads)], "q string, source string, payload string")
    good = '[{"doc_id": "a", "rank": 2, "score": 0.5}, {"doc_id": "b", "rank": 1, "score": 0.7}]'
    assert readers.checked_runs(of(good, "[]")).count() == 2
    for bad in ("no list", None, good.replace("2", "3"), good.replace('"b"', '"a"'), good.replace('"doc_id": "b", ', "")):
        with pytest.raises(ValueError, match="broken payloads"):
            readers.checked_runs(of(good, bad))


def test_query_maps_look_at_keys(spark):
    df = spark.createDataFrame([({"12": 1, "13": 2}, {"x": 1}), ({"14": 3}, {"7": 1, "y": 2, "z": 3}), (None, {})], "a map<string,int>, b map<string,int>")
    assert readers.query_maps(df) == ["a", "b"]
    assert readers.query_maps(df, pattern="^[0-9]+$") == ["a"]
    assert readers.query_maps(df.limit(0), pattern="^[0-9]+$") == []


def test_rows_are_put_in_place(spark, tmp_path):
    path = str(tmp_path / "scores")
    put = lambda rows, n: sinks.upserted_rows(spark.createDataFrame(rows, "qid long, doc_id long, score double, arm string"), path, ["qid", "doc_id", "arm"], "arm", spark.createDataFrame([(n, len(rows))], "run long, pairs long"))
    put([(1, 1, 0.1, "x"), (1, 2, 0.2, "x"), (1, 1, 0.3, "y")], 1)
    put([(1, 2, 0.9, "x"), (2, 1, 0.5, "x")], 2)
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("arm", "qid", "doc_id", "score").collect())
    assert read() == [("x", 1, 1, 0.1), ("x", 1, 2, 0.9), ("x", 2, 1, 0.5), ("y", 1, 1, 0.3)]
    with pytest.raises(ValueError, match="repeat"):
        put([(1, 1, 0.1, "x"), (1, 1, 0.2, "x")], 3)
    assert sorted(map(tuple, spark.read.parquet(path + "_progress").collect())) == [(1, 3), (2, 2)]

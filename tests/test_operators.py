"""Hand-computed toys for the retrieval engine's operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import chunking, features, fuse, learn, measure, mined, retrieve, rows, sets
from sievecraft.sources import readers, sinks

LAW = [(1, "luật đất đai luật số 10"), (2, "nghị định về đất đai và thuế"), (3, "thông tư hướng dẫn thuế thu nhập cá nhân đất"), (4, "một hai ba bốn năm sáu"), (5, "luật thuế luật thuế luật")]


def terms(spark, *words):
    return spark.createDataFrame([(0, w) for w in words], "qid long, term string")


def test_bm25_has_an_idf_floor(spark):
    docs = spark.createDataFrame(LAW, "doc_id long, text string")
    got = retrieve.bm25(terms(spark, "đất", "thuế", "luật"), docs, X.tokens(F.col("text")), 10, digits=12).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [5, 1, 2, 3]
    assert [r["score"] for r in got] == pytest.approx([0.560538753, 0.478482482, 1.976e-06, 1.677e-06], rel=1e-3)


def test_tokens_are_unicode_words(spark):
    assert spark.createDataFrame([("ế éx ‿a ①",)], "t string").select(X.tokens(F.col("t"))).first()[0] == ["ế", "e", "x", "a", "①"]


def test_sha_bucket_equals_integer_arithmetic(spark):
    got = spark.range(200).select("id", X.sha_bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] == int(hashlib.sha256(str(r["id"]).encode()).hexdigest(), 16) % 10 for r in got)


def test_rrf_ties_and_missing_ranks(spark):
    rows = [(0, "a", 1, 1), (0, "a", 2, 2), (0, "b", 2, 1), (0, "b", 1, 2), (1, "a", 1, 1), (1, "b", 2, 1)]
    runs = spark.createDataFrame(rows, "qid long, branch string, doc_id long, rank long")
    got = {(r["qid"], r["doc_id"]): (r["score"], r["rank"]) for r in fuse.rrf(runs, {"a": 0.6, "b": 0.4}, 10).collect()}
    assert got[1, 1][0] == pytest.approx(0.6 / 11 + 0.4 / 100010, abs=1e-8) and got[1, 2][0] == pytest.approx(0.4 / 11 + 0.6 / 100010, abs=1e-8)
    tied = {r["doc_id"]: r["rank"] for r in fuse.rrf(runs.where("qid = 0"), {"a": 1, "b": 1}, 0).collect()}
    assert tied == {1: 1, 2: 2}


def test_metrics_count_unanswered_queries(spark):
    import math

    gold = spark.createDataFrame([(0, "x"), (0, "y"), (1, "x")], "qid long, doc_id string")
    run = spark.createDataFrame([(0, d, k + 1) for k, d in enumerate("xabcdy")], "qid long, doc_id string, rank long")
    got = {r["qid"]: r for r in measure.query_metrics(run, gold).collect()}
    assert (got[0]["recall5"], got[0]["recall100"], got[0]["mrr10"]) == (0.5, 1, 1)
    assert got[0]["ndcg10"] == pytest.approx((1 + 1 / math.log2(7)) / (1 + 1 / math.log2(3)))
    assert got[1]["recall100"] == got[1]["mrr10"] == got[1]["ndcg10"] == 0


def test_threshold_is_relative_to_the_first(spark):
    ranked = spark.createDataFrame([(0, k, k + 1, p) for k, p in enumerate([0.9, 0.2, 0.13, 0.5, 0.0])], "qid long, doc_id long, rank long, score double")
    assert sorted(r["rank"] for r in features.threshold(ranked, 0.15).collect()) == [1, 2, 4]


@pytest.mark.parametrize("scores,z,gap", [([1.0, None, 3.0], [-1, -2, 1], [-2, -3, 0]), ([5.0, 5.0], [0, 0], [0, 0]), ([None, None], [-2, -2], [-2, -2])])
def test_z_scores(spark, scores, z, gap):
    rows = spark.createDataFrame([(0, k, s) for k, s in enumerate(scores)], "qid long, doc_id long, score double")
    got = features.z_gap(rows).orderBy("doc_id").collect()
    assert [r["z"] for r in got] == z and [r["gap"] for r in got] == gap


def test_token_windows(spark):
    docs = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (0, 500, 501, 900, 901)], "doc_id long, text string")
    got = {r["doc_id"]: r["count"] for r in chunking.token_windows(docs).groupBy("doc_id").count().collect()}
    assert got == {0: 1, 500: 1, 501: 2, 900: 2, 901: 3}


def test_best_plus_second_and_top2(spark):
    runs = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (0, 3, 1.0), (0, 4, 4.0)], "qid long, chunk_id long, score double")
    owners = spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "d1"), (4, "d2")], "chunk_id long, doc_id string")
    assert {r["doc_id"]: r["score"] for r in retrieve.best_plus_second(runs, owners).collect()} == pytest.approx({"d1": 4.2, "d2": 4.0})


def test_aliases(spark):
    gold = spark.createDataFrame([(0, "x"), (0, "x2"), (0, "e")], "qid long, doc_id string")
    got = sets.canonical(gold, spark.createDataFrame([("x2", "x")], "doc_id string, kept_id string"), spark.createDataFrame([("e",)], "doc_id string"))
    assert [r["doc_id"] for r in got.collect()] == ["x"]


def test_logistic_reaches_the_optimum(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2))
    y = (x[:, 0] + 0.5 * r.normal(size=200) > 0).astype(float)
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    w = learn.fit_logistic(rows, ("a", "b"), c=0.5)
    full = np.c_[x, np.ones(200)]
    assert abs(w + 0.5 * full.T @ (1 / (1 + np.exp(-full @ w)) - y)).max() < 1e-6


def test_sources_and_sinks(spark, tmp_path):
    import json
    import zipfile

    (tmp_path / "c").mkdir()
    (tmp_path / "c/context_1.json").write_text(json.dumps({"id": "1", "passage": "text", "link": ""}))
    (tmp_path / "c/context_2.json").write_text(json.dumps({"id": "2", "passage": "", "link": "https://x.example/van-ban/Luat-dat-dai-123.aspx"}))
    got = {r["doc_id"]: r["text"] for r in readers.documents(spark, str(tmp_path / "c")).collect()}
    assert got == {"1": "text", "2": "Luat dat dai"}
    assert {r["doc_id"] for r in readers.document_ids(spark, str(tmp_path / "c")).collect()} == {"1", "2"}
    (tmp_path / "q.json").write_text(json.dumps({"7": {"question": "what", "answer": ["1"]}, "8": {"question": "who", "answer": []}}))
    q = readers.questions(spark, str(tmp_path / "q.json"))
    assert [(r["qid"], r["question"]) for r in q.orderBy("q_ord").collect()] == [("7", "what"), ("8", "who")]
    assert readers.labelled(q).count() == 1
    a = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "qid long, doc_id long, rank long")
    sinks.answer_zip(a, str(tmp_path / "a.zip"))
    assert json.loads(zipfile.ZipFile(tmp_path / "a.zip").read("answers.json")) == {"7": {"answer": ["1", "2"]}}


def test_question_stream(spark, tmp_path):
    from sievecraft.streaming import questions

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"qid": 1, "question": "luật đất đai"}\n')
    docs = spark.createDataFrame(LAW, "doc_id long, text string")
    questions.answer_stream(spark, str(tmp_path / "in"), docs, str(tmp_path / "out"), str(tmp_path / "ck"), 2).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_trees_score_every_block(spark):
    from sievecraft.plans import registry

    d = "/root/testdata/sf0.001"
    got = registry.ml_gbt_rank(spark, d).select("qid", "doc_id").collect()
    want = registry.labelled(spark, d).select("qid", "doc_id").join(registry.runs(spark, d), ["qid", "doc_id"], "left_semi").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r["qid"] % 4 for r in got} == {0, 1, 2, 3}


def test_recomputed_metric_finds_a_fault(spark, monkeypatch):
    from sievecraft.plans import registry

    d, right = "/root/testdata/sf0.001", measure.query_metrics
    n, different = registry.val_metric_recompute(spark, d).first()
    assert n == registry.gold(spark, d).select("qid").distinct().count() and different == 0
    monkeypatch.setattr(measure, "query_metrics", lambda run, gold: right(run, gold).withColumn("ndcg10", F.col("ndcg10") + 0.1))
    assert registry.val_metric_recompute(spark, d).first()["different"] == n


def test_bootstrap_takes_as_many_samples_as_the_reference():
    import inspect

    assert inspect.signature(measure.bootstrap).parameters["samples"].default == 20_000


def test_bundle_has_four_branches_at_full_depth(spark, tmp_path):
    from sievecraft.plans import registry

    texts = [(k, f"red fish swim north of stone {k}") for k in range(70)] + [(70, " ".join(["red fish swim north"] * 150))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = [(0, "red fish swim"), *((k, f"red fish {k}") for k in range(1, 40))]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = registry.bundle(spark, str(tmp_path)).collect()
    of = {b: {r["doc_id"]: r["score"] for r in got if r["branch"] == b and r["qid"] == 0} for b in ("full", "local", "trigram", "memory")}
    assert {b: len(x) for b, x in of.items()} == {"full": 71, "local": 71, "trigram": 71, "memory": 12}
    near = registry.neighbours(spark, str(tmp_path), 100).where("qid = 0").collect()
    assert len(near) == 39 and of["memory"][3] == pytest.approx(sum(max(r["score"], 0) / (10 + r["rank"]) for r in near if r["other"] % 7 == 3), abs=1e-8)


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


# ---------------------------------------------------------------- rows, audits, storage

from sievecraft.operators import rows as rank_rows  # noqa: E402
from sievecraft.operators import validate  # noqa: E402


def test_score_rows_by_hand(spark):
    lists = [(0, "a", 1, 4.0, 1), (0, "a", 2, 2.0, 2), (0, "b", 2, 5.0, 1), (0, "c", 2, 8.0, 1), (0, "c", 1, 4.0, 2)]
    r = spark.createDataFrame(lists, "qid long, branch string, doc_id long, score double, rank long")
    got = {x["doc_id"]: x for x in rank_rows.score_rows(r, ("a", "b", "c", "d")).collect()}
    assert got[2]["rr0"] == pytest.approx(1 / 7) and got[2]["rr1"] == pytest.approx(1 / 6) and got[2]["rr3"] == 0
    assert got[2]["sc0"] == 0.5 and got[2]["lists"] == 3 and got[2]["here12"] == 1 and got[2]["sc12"] == 1
    assert got[1]["sc2"] == 0.5 and got[1]["lists"] == 2 and got[1]["here12"] == 0 and len(got[1]) == 25


def test_lexical_rows_by_hand(spark):
    p = spark.createDataFrame([(0, 1, "Điều 5 thuế đất đai là gì", "theo điều 5 của luật thuế đất"), (0, 2, "", "x"), (0, 3, "a b", None)], "qid long, doc_id long, question string, text string")
    got = {x["doc_id"]: x for x in rank_rows.lexical_rows(p).collect()}
    assert got[1]["cover"] == pytest.approx(4 / 7) and got[1]["cover_numbers"] == 1 == got[1]["all_numbers"] and got[1]["cover_cites"] == 1
    assert got[1]["cover_content"] == pytest.approx(3 / 4) and got[1]["cover_bi"] == pytest.approx(2 / 6) and got[1]["any_tri"] == 0
    assert got[2]["cover"] == 0 == got[3]["cover"] and got[3]["doc_length"] > 0
    off = rank_rows.lexical_rows(p, F.col("doc_id") != 1).where("doc_id = 1").first()
    assert off["cover"] == 0 and off["doc_length"] == got[1]["doc_length"]


def test_legal_text_functions(spark):
    text = "QUỐC HỘI\nSố: 12/2020/QH14\nLUẬT\nĐất đai  sửa đổi\nCăn cứ Hiến pháp; Số: 45/2013/QH13; Điều 1 Phạm vi Số 9/2001/QH10"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(X.legal_title(F.col("t")).alias("title"), X.doc_class(F.col("t")).alias("kind"), X.own_number(F.col("t"), 300, X.MARKED_NUMBER).alias("own"), X.cited_documents(F.col("t")).alias("cited")).collect()
    assert row[0]["title"] == "Đất đai sửa đổi" and row[0]["kind"] == "LUAT" and row[0]["own"].startswith("12/2020/QH") and [x[:10] for x in row[0]["cited"]] == ["45/2013/QH"]
    assert (row[1]["title"], row[1]["kind"], row[1]["own"], row[1]["cited"]) == ("", "KHAC", None, [])
    assert spark.range(1).select(X.named_numbers(F.lit("theo Thông tư 31/2022/TT-BTC và 5/qđ"))).first()[0] == ["31/2022/TT-BTC", "5/QĐ"]


def test_order_statistic_equals_a_sorted_list(spark):
    import random

    r = random.Random(2)
    for n in (1, 2, 7, 40, 3000):
        v = [float(r.choice([r.randint(0, 5), r.randint(0, 10**6)])) for _ in range(n)]
        for share in (0.0, 0.5, 0.95):
            got = measure.order_statistic(spark.createDataFrame([(x,) for x in v], "v double"), share).collect()
            assert [x["p95"] for x in got] == [sorted(v)[int(n * share)]]


def test_gates_and_choices(spark):
    t = spark.createDataFrame([("x", 0, 0.5, 0.2), ("x", 1, 0.9, 0.2), ("y", 0, 0.6, 0.1), ("y", 1, 0.7, 0.1)], "config string, block int, recall double, precision double")
    assert [(r["config"], r["place"]) for r in learn.worst_block_choice(t).orderBy("place").collect()] == [("y", 1), ("x", 2)]
    g = spark.createDataFrame([("x", 0, 0.3, 0.2, 0.1), ("x", 1, 0.3, 0.2, 0.1), ("y", 0, 0.3, 0.2, 0.5)], "config string, losses int, precision double, base_precision double, gain double")
    assert {r["config"]: r["safe"] for r in learn.safe_gate(g).collect()} == {"x": 0, "y": 1}
    p = spark.createDataFrame([(1, 0.9, 5, 9), (2, 0.8985, 2, 9), (3, 0.896, 1, 9)], "id long, recall double, models int, features int")
    assert {r["tolerance"]: r["id"] for r in learn.smallest_within(p).collect()} == {0.001: 1, 0.003: 2, 0.005: 3}
    c = spark.createDataFrame([(0.2, 0.2, 10, 1), (0.9, 0.1, 20, 2)], "a double, b double, k int, place int")
    assert tuple(learn.centroid(c, ("a", "b")).first()) == (0.5, 0.5, 10)


def test_validators(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 3)], "qid long, doc_id long")
    assert tuple(validate.membership(a, a.where("doc_id <> 2")).first()) == (2, 1)
    assert tuple(validate.covers(a, spark.createDataFrame([(0,), (2,)], "qid long"), "qid").first()) == (1, 1, 1)
    assert tuple(validate.answers(a, spark.createDataFrame([(0,), (1,), (2,)], "qid long"), spark.createDataFrame([(1,), (2,)], "doc_id long")).first()) == (1, 0, 0, 1)
    assert validate.leakage(a, a.where("qid = 1")).first()[0] == 1


def test_fusions_of_scores_and_graphs(spark):
    r = spark.createDataFrame([(0, "a", 1, 1, 3.0), (0, "a", 2, 2, 1.0), (0, "b", 2, 1, 5.0)], "qid long, branch string, doc_id long, rank long, score double")
    z = {x["doc_id"]: x["score"] for x in fuse.z_blend(r, r.select("qid", "doc_id").distinct(), ("a", "b")).collect()}
    assert z == {1: pytest.approx(-1.0), 2: pytest.approx(-1.0)}
    g = {x["doc_id"]: x["score"] for x in fuse.graph_rerank(r.where("branch = 'a'"), spark.createDataFrame([(1, 9, 0.5)], "src long, dst long, strength double")).collect()}
    assert g[9] == pytest.approx(1 / 100_010 + 0.3 / 11, abs=1e-9) and g[1] == pytest.approx(1 / 11, abs=1e-9)


def test_folders_and_sinks(spark, tmp_path):
    import json

    import numpy as np

    for k in ("a/x.bin", "b/x.bin"):
        (tmp_path / "tree" / k).parent.mkdir(parents=True)
        (tmp_path / "tree" / k).write_bytes(k.encode())
    files = readers.file_hashes(spark, str(tmp_path / "tree"))
    assert {r["name"]: r["h"] for r in files.collect()} == {k: hashlib.sha256(k.encode()).hexdigest() for k in ("a/x.bin", "b/x.bin")}
    want = files.collect()
    (tmp_path / "tree" / "b" / "x.bin").write_bytes(b"other")
    assert tuple(validate.manifest(readers.file_hashes(spark, str(tmp_path / "tree")), spark.createDataFrame(want)).first()) == (2, 0, 0, 1)
    (tmp_path / "v.f16").write_bytes(np.arange(12, dtype=np.float16).tobytes())
    ids = spark.createDataFrame([(k, 10 + k) for k in range(3)], "row long, vec_id long")
    assert {r["vec_id"]: list(r["embedding"]) for r in readers.vectors(spark, str(tmp_path / "v.f16"), ids, 4).collect()}[12] == [8, 9, 10, 11]
    with pytest.raises(ValueError):
        readers.vectors(spark, str(tmp_path / "v.f16"), ids.where("row < 2"), 4)
    df = spark.createDataFrame([(2, "y"), (1, "x")], "qid long, v string")
    first = sinks.written_once(df, str(tmp_path / "out"), "qid")
    assert sinks.written_once(df.orderBy("qid"), str(tmp_path / "out"), "qid") == first
    assert [json.loads(r[0])["qid"] for r in spark.read.text(str(tmp_path / "out")).collect()] == [1, 2]
    with pytest.raises(ValueError):
        sinks.written_once(df.limit(1), str(tmp_path / "out"), "qid")
    sinks.upserted(df, str(tmp_path / "up"), "qid")
    sinks.upserted(spark.createDataFrame([(2, "z")], "qid long, v string"), str(tmp_path / "up"), "qid")
    assert {r["qid"]: r["v"] for r in spark.read.parquet(str(tmp_path / "up")).collect()} == {1: "x", 2: "z"}
    sinks.appended(df, str(tmp_path / "log"), "one")
    with pytest.raises(ValueError):
        sinks.appended(df, str(tmp_path / "log"), "two")
    assert sinks.missing(df, spark.read.parquet(str(tmp_path / "log")).where("qid = 1"), ["qid"], "one").count() == 1
    assert {r["v"] for r in sinks.latest(spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k long, v string, at long"), ["k"], "at").collect()} == {"new"}
    table = spark.createDataFrame([("c1", "t"), ("c2", "u"), ("c2", "u")], "chunk_id string, text string")
    assert readers.looked_up(table, table.where("chunk_id = 'c1'")).count() == 1
    with pytest.raises(ValueError):
        readers.looked_up(table, table)
    maps = spark.createDataFrame([], "a struct<scores: map<string,double>, n: int>, b map<string,string>")
    assert readers.query_maps(maps) == ["a.scores", "b"]
    (tmp_path / "chunks.json").write_text(json.dumps({"id": "d", "chunk": {"0": "one", "1": " "}}) + "\n")
    assert [tuple(r) for r in readers.chunks(spark, str(tmp_path / "chunks.json")).collect()] == [("d", "0", "one")]
    (tmp_path / "lines.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "lines.json"), "a int").count() == 2
    runs = spark.createDataFrame([("q", "s", '[{"doc_id": "d", "rank": 1, "score": 0.5}]')], "q string, source string, payload string")
    assert tuple(readers.payload_runs(runs).first()) == ("q", "s", "d", 1, 0.5)
    assert tuple(readers.signature(spark, str(tmp_path / "tree" / "a")).first()) == (1, 7)


def test_top_passages_equal_a_plain_version(spark):
    import math
    import random
    import re

    r = random.Random(6)
    vocab = [f"từ{k}" for k in range(60)] + ["thuế", "đất", "2020", "năm2021", "quy", "định"]
    pairs = [(k, k, " ".join(r.choice(vocab) for _ in range(r.randint(0, 12))), " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate([0, 5, 300, 301, 520, 521, 1000, 1400])]
    got = {(x["qid"], x["rank"]): x["passage"] for x in chunking.top_passages(spark.createDataFrame([*pairs, (9, 9, None, None)], "qid long, doc_id long, question string, text string")).collect()}
    assert got.pop((9, 1)) == ""
    want = {}
    for q, _, question, text in pairs:
        toks, words = re.findall(r"\w+", question.lower()), text.split()
        if len(words) <= 300:
            want[q, 1] = " ".join(words)
            continue
        scored, start = [], 0
        while True:
            part = " ".join(words[start : start + 220])
            c = re.findall(r"\w+", part.lower())
            total = sum(1 + 0.2 * min(c.count(t), 3) for t in set(toks) if len(t) >= 3 and t in c and t not in X.PASSAGE_STOP_WORDS)
            total += 3 * len({t for t in toks if any(x.isdigit() for x in t)} & set(c)) + 1.8 * sum(f"{a} {b}" in " ".join(c) for a, b in set(zip(toks, toks[1:])))
            scored.append((-round(total / math.sqrt(len(c)), 9), -round(total, 9), start, part if start < 70 else " ".join(words[:70]) + chunking.HEADER_MARK + part))
            if start + 220 >= len(words):
                break
            start += 150
        for k, x in enumerate(sorted(scored)[:2], 1):
            want[q, k] = x[3]
    assert got == want


def test_quotas_of_negatives(spark):
    rows = lambda docs: spark.createDataFrame([(1, d, k) for k, d in enumerate(docs, 1)], "qid long, doc_id long, rank int")
    gold, universe = spark.createDataFrame([(1, 11)], "qid long, doc_id long"), spark.range(100, 130).withColumnRenamed("id", "doc_id")
    args = (rows(range(10, 16)), rows([20, 10, 21]), rows([22, 11, 21, 23]), rows([14, 10, 30]), universe, gold)
    quotas = {"hardest": 2, "middle": 1, "disagreement": 9, "confuser": 2, "random": 1}
    got = [(r["doc_id"], r["source"]) for r in mined.quota_negatives(*args, quotas=quotas).orderBy("pick").collect()]
    assert got[:2] == [(10, "hardest"), (12, "hardest")] and len(got) == len(set(d for d, _ in got)) == 15 and 11 not in {d for d, _ in got}
    of = lambda s: {d for d, x in got if x == s}
    # the third row of the longer list stands within the shorter one's length, its fourth does not
    assert of("middle") <= {13, 14, 15} and of("disagreement") == {20, 21, 22} and of("random") <= set(range(100, 130))
    assert of("middle") | of("confuser") | of("backfill") == {13, 14, 15, 30} and len(of("random")) == 1 and of("backfill_random") <= set(range(100, 130))
    again = [(r["doc_id"], r["source"]) for r in mined.quota_negatives(*args, quotas=quotas).orderBy("pick").collect()]
    assert again == got
    many = mined.quota_negatives(rows([]), *args[1:], quotas=quotas)
    assert many.count() == 0


def test_swaps_by_utility(spark):
    run = spark.createDataFrame([(q, 10 * q + r, r, 1.0 / r) for q in (1, 2) for r in range(1, 9)], "qid long, doc_id long, rank int, score double")
    acts = rows.actions(run, ("score",))
    gold = spark.createDataFrame([(1, 17), (1, 11), (2, 25)], "qid long, doc_id long")
    got = {(r["qid"], r["challenger"]): (r["target"], r["weight"]) for r in mined.action_targets(acts, gold).collect()}
    assert got[1, 17] == (0.5, 1.0) and got[1, 16] == (0.0, 0.15) and got[2, 26] == (-1.0, 1.0) and len(got) == 6
    u = spark.createDataFrame([(1, 16, 0.3, 0.2), (1, 17, 0.35, 0.2), (2, 26, 0.3, 0.0)], "qid long, challenger long, new_rank double, utility double")
    out = {(r["qid"], r["rank"]): r["doc_id"] for r in mined.swapped(run, u).collect()}
    assert out[1, 5] == 16 and out[2, 5] == 25 and len(out) == 10


def test_memory_rows_by_hand(spark):
    near = spark.createDataFrame([(1, 2, 0.5, 1), (1, 3, 0.25, 2)], "qid long, other long, score double, rank int")
    gold = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (3, 8)], "qid long, doc_id long")
    got = {r["doc_id"]: r for r in mined.memory_rows(spark.createDataFrame([(1, 7), (1, 9)], "qid long, doc_id long"), near, gold).collect()}
    assert [got[7][c] for c in ("n", "best", "total", "rr", "first", "n1", "n5", "share", "freq")] == [2, 0.5, 0.75, 1.5, 1, 1, 2, 1.0, 2] and got[7]["prior"] == pytest.approx(1.0)
    assert got[7]["votes"] == pytest.approx(0.5 / 11 + 0.25 / 12) and got[9]["n"] == got[9]["freq"] == 0 and len(mined.MEMORY) == 14


def test_numbers_named_in_questions(spark):
    q = spark.createDataFrame([(1, "theo 12/2020/NĐ-CP"), (2, None)], "qid long, text string").select("qid", X.named_numbers(F.col("text")).alias("numbers"))
    owners = spark.createDataFrame([(5, "12/2020/NĐ-CP"), (6, None)], "doc_id long, own string")
    got = mined.named_in_question(spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "qid long, doc_id long"), q, owners).orderBy("qid", "doc_id").collect()
    assert [r["named"] for r in got] == [1.0, 0.0, 0.0]


def test_channels_matrices_and_vectors(spark, tmp_path):
    import numpy as np

    (tmp_path / "a.json").write_text('{"1": {"7": 0.5, "8": 0.25}, "2": {}}')
    (tmp_path / "b.json").write_text('{"scores": {"1": {"9": 1.0}}}')
    assert {(r["qid"], r["doc_id"], r["score"]) for r in readers.channels(spark, str(tmp_path / "a.json"), "x").collect()} == {("1", "7", 0.5), ("1", "8", 0.25)}
    assert [(r["branch"], r["doc_id"]) for r in readers.channels(spark, str(tmp_path / "b.json"), "y").collect()] == [("y", "9")]
    m = np.arange(21, dtype=np.float16).reshape(7, 3)
    np.save(tmp_path / "m.npy", m)
    got = {r["row"]: r["embedding"] for r in readers.npy_rows(spark, str(tmp_path / "m.npy"), 2).collect()}
    assert [got[k] for k in range(7)] == m.astype(float).tolist()
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()

    def encode(some):
        if len(some) > 10:
            raise MemoryError
        return [[len(x), 1.0] for x in some]

    texts = spark.createDataFrame([(k, "x" * k if k else None) for k in range(30)], "id long, t string")
    for part in (texts.where("id < 20"), texts):
        sinks.vectors_appended(part, str(tmp_path / "v"), "id", "t", encode, 2)
    assert {r["id"]: r["embedding"] for r in spark.read.parquet(str(tmp_path / "v")).collect()} == {k: [float(k), 1.0] for k in range(30)}

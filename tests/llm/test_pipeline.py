"""The pipeline against a version of its stages in plain Python, on a small table."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from sievecraft.llm import langid, line_dedup, mixing, queries, simhash
from tests.llm.test_dedup import LAST, brute_components, brute_fingerprint, brute_lines

P = pytest.importorskip("public_tokenizers")


def plain_mix(docs):
    """Words taken of each document (source, size): sources to 3, 1, 2 shares of 150 % of all words, twice their own at most.

    A source is a circle of its documents in the order of a hash; the words up to its target are taken, going round.
    """
    sums = defaultdict(int)
    for s, n in docs.values():
        sums[s] += n
    order, full = sorted(sums, key=lambda s: (s is None, s)), set()
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    while True:
        open_ = [s for s in order if s not in full]
        left = 1.5 * sum(sums.values()) - sum(2 * sums[s] for s in full)
        target = {s: 2 * sums[s] for s in full} | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        if not (over := {s for s in open_ if target[s] > 2 * sums[s]}):
            break
        full |= over
    taken = dict.fromkeys(docs, 0)
    for s in order:
        left = min(int(target[s] + 1e-6), 2 * sums[s])
        circle = sorted((d for d in docs if docs[d][0] == s and docs[d][1]), key=lambda d: hashlib.md5(f"{'' if d is None else d}:mix".encode()).hexdigest())
        for d in [*circle, *circle]:
            n = min(left, docs[d][1])
            taken[d] += n
            left -= n
    return taken


def test_pipeline(spark, docs, rows, tmp_path):
    import tiktoken

    import corpus_pipeline
    from sievecraft.llm.bpe import read_ranks

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    models = langid.fit_language_models(docs)
    rejected = models.predict([t for _, t, *_ in rows])[2]
    kept = [r for r, bad in zip(rows, rejected) if not bad]
    assert len(kept) >= len(rows) - 8
    texts = Counter((d, t) for d, t, _, _ in brute_lines(kept))
    source = {d: s for d, _, _, s, _ in kept}
    lined = list(texts.elements())
    fps = [(d, brute_fingerprint(t)) for d, t in lined]
    comp = brute_components(fps)
    stay = {}
    for (d, t), (_, f) in zip(lined, fps):
        if d == comp[f]:
            stay[d] = t
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = plain_mix({d: (source[d], size(t)) for d, t in stay.items()})
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(queries.VOCABULARY)), special_tokens={})
    want = []
    for d, t in stay.items():
        n = taken[d]
        while n > 0:
            part = t if n >= size(t) else " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)[:n])
            ids = enc.encode_ordinary(part)
            want.append((d, len(ids), hashlib.sha256(part.encode()).hexdigest()))
            n -= size(t)
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert LAST and defaultdict


def test_stages_keep_the_columns_and_take_empty_tables(spark, docs, nothing):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, "").columns == docs.columns
        assert stage(spark, nothing, "").count() == 0
        assert stage(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, "").count() == 0


def test_stages_take_columns_that_clash(spark, docs):
    import corpus_pipeline
    from pyspark.sql import functions as F

    wide = docs
    for name in ("key", "th", "fp", "slot", "size", "s", "rank", "first", "places", "tag", "rejected_by", "component_id", "kept"):
        wide = wide.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns and out.where("key <> 'x' or slot <> 'x' or th <> 'x'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").count() == docs.count()


def test_clean_documents_stay(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stayed = corpus_pipeline.language(spark, docs, "").count()
    assert stayed >= 0.98 * docs.count()


def test_stages_keep_columns_of_any_name(docs, rows):
    """Columns that are called as an operator's own would be do not clash with these."""
    more = docs.selectExpr("*", "1 as __sc_t", "2 as __SC_I", "3 as __sc_h", "4 as __sc_g", "5 as __sc_n", "6 as __sc__t", "7 as __sc_e", "8 as __sc_k", "9 as __sc_size")
    for f in (line_dedup.line_dedup, simhash.one_per_group, mixing.mixed_documents):
        plain, got = f(docs), f(more)
        assert [c for c in got.columns if c in more.columns] == more.columns
        assert Counter(map(str, got.select(*plain.columns).collect())) == Counter(map(str, plain.collect()))
        assert {tuple(r) for r in got.select("__sc_t", "__SC_I", "__sc__t").distinct().collect()} == {(1, 2, 6)}

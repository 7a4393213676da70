"""Source divergence and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sievecraft.llm import divergence, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_levels(nodes):
    """Digests by level, from the nodes to the single one."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def plain_manifest(rows):
    leaf = lambda r, text: H(*[framed(x) for x in (r[0], r[3], r[2], r[4], text)])
    groups = defaultdict(list)
    for r in rows:
        own = leaf(r, r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        changed = leaf(r, None if r[1] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[1])) if hit else own
        groups[r[3]].append(((r[0] is not None, r[0] or 0, own), r[0], own, changed))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(groups[s])]) for s in order}
    over = plain_levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, (_, doc_id, own, changed) in enumerate(sorted(groups[s])):
            proof, acc = "", changed
            for levels, k in ((trees[s], i), (over, at)):
                for level in levels[:-1]:
                    run = level[k // 16 * 16 : k // 16 * 16 + 16]
                    left, right = "".join(run[: k % 16]), "".join(run[k % 16 + 1 :])
                    proof, acc, k = proof + left + right, H(left, acc, right), k // 16
            out.append((doc_id, own, trees[s][-1][0], over[-1][0], H(proof), acc, acc == over[-1][0]))
    return out


def test_manifest_equals_plain_version(spark, docs, rows):
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert Counter(got) == Counter(plain_manifest(rows))


def test_manifest_of_many_sources_and_deep_trees(spark):
    r = random.Random(3)
    rows = [(k, "Text " + str(k), "en", None if k % 50 == 0 else "hot" if k % 3 else f"s{r.randint(0, 40)}", k) for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = [tuple(x) for x in merkle.manifest(df).collect()]
    assert Counter(got) == Counter(plain_manifest(rows))
    tampered = {x[0] for x in got if not x[6]}
    assert tampered == {k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0}


@pytest.mark.parametrize("n", [1, 16, 17])
def test_manifest_at_the_edges_of_a_run(spark, n):
    rows = [(k, "A", None, "only", None) for k in range(n)]
    got = [tuple(x) for x in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert Counter(got) == Counter(plain_manifest(rows))


def test_manifest_empty_and_clashing_names(spark, nothing, docs, rows):
    assert merkle.manifest(nothing).collect() == []
    more = docs.selectExpr("*", "1 as g", "2 as i", "3 as n", "'x' as digest", "'y' as leaf", "0 as part")
    assert Counter(tuple(r) for r in merkle.manifest(more).collect()) == Counter(plain_manifest(rows))


def plain_divergence(rows, k, min_docs):
    times, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        times[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    p_of = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update({t: times[g][t] for t in kept})
        total, v = sum(whole.values()), len(kept)
        p = {s: {t: p_of(times[x, s][t], sum(times[x, s][u] for u in kept), v) for t in kept} for x, s in groups if x == lang}
        for s in p:
            far = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o != s]
            out += [(lang, s, "pair", o.decode(), -d, i + 1) for i, (d, o) in enumerate(sorted(far))]
            marks = [(p_of(whole[t], total, v) - p[s][t], t.encode()) for t in kept if times[lang, s][t] > 0 and p[s][t] > p_of(whole[t], total, v)]
            out += [(lang, s, "term", t.decode(), -d, i + 1) for i, (d, t) in enumerate(sorted(marks)[:k])]
    return out


@pytest.mark.parametrize("k, min_docs", [(50, 30), (3, 2), (1, 1), (5, 1000)])
def test_divergence_equals_plain_version(docs, rows, k, min_docs):
    got = [tuple(r) for r in divergence.source_divergence(docs, k, min_docs).collect()]
    assert Counter(got) == Counter(plain_divergence(rows, k, min_docs))


def test_divergence_with_many_buckets_and_ties(spark):
    r = random.Random(5)
    terms = [f"t{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(10)]
    rows = []
    for n in range(300):
        source = "hot" if n % 3 == 0 else f"s{n % 5}"
        rows.append((n, " ".join(r.choices(terms, [1 / (1 + (j + len(source)) % 60) for j in range(200)], k=r.randint(0, 300))), "en" if n % 4 else "de", source, 0))
    got = [tuple(x) for x in divergence.source_divergence(spark.createDataFrame(rows, SCHEMA), 4, 5).collect()]
    assert Counter(got) == Counter(plain_divergence(rows, 4, 5))


def test_divergence_counts_in_parts(docs):
    whole = Counter(tuple(r) for r in divergence.term_counts(docs).collect())
    assert Counter(tuple(r) for r in divergence.term_counts(docs, held=7).collect()) == whole


def test_divergence_finds_a_sources_own_terms(spark):
    rows = [(n, " ".join(f"a{'b' * j} " * (40 - j) for j in range(40)) + f" x{chr(97 + n % 26)} z{chr(97 + n // 26)}", "en", "p" if n % 2 else "q", 0) for n in range(200)]
    rows += [(1000 + n, "only here " * 50, "en", "p", 0) for n in range(30)]
    postings, groups = divergence.tables(spark.createDataFrame(rows, SCHEMA), 1)
    got = {(r.source, r.item) for r in divergence.marking_terms(postings, groups, 2).collect()}
    assert {("p", "only"), ("p", "here")} <= got


def test_divergence_long_division(spark):
    from pyspark.sql import functions as F

    values = [(3 * 10**12, 4 * 10**14, 10**6), (0, 1, 1), (7, 7, 3), (10**14, 10**14, 5)]
    got = spark.createDataFrame(values, "a long, b long, c long").select(divergence.share(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (a + 5) // (b + 5 * c) for a, b, c in values]


def test_divergence_empty_and_clashing_names(nothing, docs, rows):
    assert divergence.source_divergence(nothing).collect() == []
    more = docs.selectExpr("*", "1 as term", "2 as n", "'x' as item", "3 as docs", "4 as value")
    assert Counter(tuple(r) for r in divergence.source_divergence(more, 3, 2).collect()) == Counter(plain_divergence(rows, 3, 2))

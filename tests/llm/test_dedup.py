import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sievecraft.llm import components, exact_dedup, line_dedup, simhash, substring_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), LAST if d is None else d))
    out = []
    for d, t, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        n, keep = min(groups[norm])
        same = (LAST if d is None else d) == keep and -len(t or "") == n
        out.append((d, None if keep == LAST else keep, len(groups[norm]), same, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, rows, weak):
    hashed = (lambda c: F.pmod(F.xxhash64(c), F.lit(3))) if weak else F.xxhash64
    got = exact_dedup.exact_dedup(docs.withColumn("chunks", F.lit(1)).withColumn("norm", F.lit("x")), chunk_hash=hashed).drop("n_chunks").collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)


def test_exact_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_chunks_follow_content(spark):
    a = "".join(f"Sentence number {k} of this text ends here." for k in range(200))
    df = spark.createDataFrame([("A" + a,), ("Inserted in front." + a,)], "norm string")
    x, y = (set(r[0]) for r in df.select(exact_dedup.content_chunks(F.col("norm"), 64, 256)).collect())
    assert len(x & y) > 0.7 * len(x)


def brute_fingerprint(text):
    words = W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: (doc_id, fp); component of each fp by trying all pairs."""
    values = sorted({f for _, f in fps})
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), LAST))
    return {f: least.get(find(f)) for f in values}


@pytest.mark.parametrize("block", [4096, 2])
def test_simhash(docs, rows, block):
    want = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    comp = brute_components(want)
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit(0)), block=block).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == sorted(((d, f"{f:016x}", comp[f]) for d, f in want), key=str)


@pytest.mark.parametrize("block", [4096, 3])
def test_links_of_dense_and_random_fingerprints(spark, block):
    import random

    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    centre = r.getrandbits(64)
    for _ in range(400):  # a large group around one fingerprint, with chains
        x = centre
        for b in r.sample(range(64), r.randint(0, 7)):
            x ^= 1 << b
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
    pairs = [(u & (1 << 64) - 1, v & (1 << 64) - 1) for u, v in links.collect()]
    assert all((u ^ v).bit_count() <= 4 for u, v in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        root[find(u)] = find(v)
    want = brute_components([(k, f) for k, f in enumerate(sorted(fps))])
    assert len({find(f) for f in fps}) == len(set(want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_rows_without_id_hold_components_together(spark, monkeypatch):
    hub = 0x5A5A_5A5A_5A5A_5A5A
    # Eleven fingerprints two bits from the hub and four from each other, and a bridge between two that are eight bits apart.
    near = {k: hub ^ (3 << 2 * k) for k in range(11)}
    left, bridge, right = 0x0123_4567_89AB_CDEF, 0x0123_4567_89AB_CDEF ^ 0x0F, 0x0123_4567_89AB_CDEF ^ 0xFF
    fps = [(None, hub), *((10 + k, x) for k, x in near.items()), (40, left), (None, bridge), (41, right), (None, 0x7FFF_0000_FFFF_0001)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *a: docs)
    table = spark.createDataFrame([(d, k, x) for k, (d, x) in enumerate(fps)], "doc_id long, th long, fp long")
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(table).collect()}
    comp = brute_components(fps)
    assert got == {(d, x): comp[x] for d, x in fps}
    assert {got[10 + k, x] for k, x in near.items()} == {10} and got[41, right] == 40


def test_simhash_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def brute_lines(rows, min_docs=3):
    def keys(line):
        w = W.findall(re.sub(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", line))
        n, m = len(w), len(w) - 2
        if n < 3:
            return []
        out, cut = [(n, 0, tuple(w))], [2 + q * m // 4 for q in range(5)]
        for i in range(4):
            for j in range(i, 4):
                gone = {x for q in {i, j} for x in range(cut[q], cut[q + 1])}
                if all(cut[q + 1] > cut[q] for q in (i, j)) and 2 * len(gone) <= n:
                    out.append((n, 10 * i + j + 1, tuple(x for k, x in enumerate(w) if k not in gone)))
        return out

    where = defaultdict(list)
    for d, t, *_ in rows:
        for k in {k for line in (t or "").split("\n") for k in keys(line)}:
            where[k].append(LAST if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not any(len(where[k]) >= min_docs and min(where[k]) < (LAST if d is None else d) for k in keys(x))]
        out.append((d, t if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_lines(docs, rows):
    got = line_dedup.line_dedup(docs.withColumn("th", F.lit(5)).withColumn("key", F.lit("k"))).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_lines_generalise_fields(spark):
    lines = [(k, f"Posted by user{k} on day {k} in the morning of a long and quiet week") for k in range(4)]
    lines += [(10 + k, f"seen near the old harbour by {name} late that evening with a lamp") for k, name in enumerate(["Anna", "Bert", "Carl"])]
    lines += [(20, "a line of its own that nobody else has written down")]
    # Two fields in different quarters, and a short line with a field after its lead.
    lines += [(30 + k, f"we met {a} in the market hall of the town and spoke with {b} about it") for k, (a, b) in enumerate([("Anna", "Dora"), ("Bert", "Emil"), ("Carl", "Fred")])]
    lines += [(40 + k, f"Posted by {a} in {b}") for k, (a, b) in enumerate([("anna", "travel"), ("bert", "food"), ("carl", "art")])]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 10: 0, 11: 1, 12: 1, 20: 0, 30: 0, 31: 1, 32: 1, 40: 0, 41: 1, 42: 1}


def test_lines_empty(nothing):
    assert line_dedup.line_dedup(nothing).count() == 0


def brute_windows(rows, window):
    first = {}
    for d, t, *_ in rows:
        w = W.findall(t or "")
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, LAST), d)
    out = []
    for d, t, *_ in rows:
        w, gone = W.findall(t or ""), set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


def test_substrings_of_shared_and_missing_ids(spark, tmp_path):
    import duckdb

    from sievecraft.llm import queries

    r = __import__("random").Random(4)
    a, y, z = (" ".join(f"{c}{r.randrange(1000)}" for _ in range(40)) for c in "ayz")
    rows = [(1, a), (2, a), (2, z), (2, z), (None, a), (None, y), (3, y + " " + a), (3, None), (4, z + " " + y)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = queries.op6_substring_dedup(spark, str(tmp_path)).collect()
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute_windows(rows, 13)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    sql = duckdb.sql(queries.OP6.replace("FROM documents", f"FROM '{path}/*.parquet'")).fetchall()
    assert sorted(sql, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("window,slab", [(13, 1 << 20), (13, 500), (5, 64)])
def test_substrings(docs, rows, window, slab, monkeypatch):
    # The functions that run in the workers see a small slab through a closure made here.
    import types

    fn = substring_dedup._windows
    if slab != 1 << 20:
        fn = types.FunctionType(fn.__code__, dict(substring_dedup.__dict__, _SLAB=slab), fn.__name__, fn.__defaults__, fn.__closure__)
        monkeypatch.setattr(substring_dedup, "_windows", fn)
    got = substring_dedup.substring_dedup(docs.withColumn("places", F.lit(0)), window=window).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_windows(rows, window)


def test_rabin_karp_is_the_polynomial():
    import numpy as np

    r = np.random.default_rng(1).integers(0, 1 << 64, 40, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    for window in (1, 2, 3, 5, 8, 13):
        got = substring_dedup.rabin_karp(r, window, np.uint64(base)).tolist()
        want = []
        for i in range(len(r) - window + 1):
            h = 0
            for x in r[i : i + window].tolist():
                h = (h * base + x) % (1 << 64)
            want.append(h)
        assert got == want


def test_substrings_empty(nothing):
    assert substring_dedup.substring_dedup(nothing).count() == 0

"""Near-duplicate detection by SimHash fingerprints and multi-index hashing.

A document's 64-bit fingerprint is the majority of the XXH64 hashes of its word shingles. To find all fingerprints
within ``max_distance`` = 4 bits, the fingerprint is cut into three segments: of two such fingerprints at least one
segment differs in one bit at most. So each distinct fingerprint is filed under its three segment values and looks them
up again with every ball of radius one around them (only by setting clear bits: of two values one bit apart, one of
the two looks the other up). Members that meet in a table entry are verified by their complete distance.

Skew: copies collapse into one fingerprint before anything is filed. Entries with more than ``block`` members are dealt
as pairs of blocks to many tasks; within a task a breadth-first walk emits a spanning forest only, so the links that
leave a task are fewer than its rows, whatever the size of a group. All links are kept up to connectivity.

Defined results: null and empty texts have fingerprint zero and link like any other; rows without an id get the
component of their fingerprint but name none; repeated rows get equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievecraft.llm.batches import short_batches
from sievecraft.llm.components import connected_components
from sievecraft.llm.hot import join_per_key
from sievecraft.llm.names import fresh
from sievecraft.session import checkpointed

SEED = 42
#: Width in bits of each segment, from the low end.
SEGMENTS = (22, 21, 21)
_SLAB = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """Majority fingerprint of the shingles of ``words_per_shingle`` words; 0 without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    a, b = starts[: n - words_per_shingle + 1].tolist(), ends[words_per_shingle - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(a), _SLAB):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[at : at + _SLAB], b[at : at + _SLAB])], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(a), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """doc_id, th (hash of the text), fp (the unsigned fingerprint as a signed long) of every row, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words_per_shingle) for t in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], names=["doc_id", "th", "fp"])

    picked = short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, th long, fp long")


def _filed(points: DataFrame) -> DataFrame:
    """key, fp, looks (0 filed, 1 looking up) for each table entry a fingerprint is filed or looked up under."""
    out, low = [], 0
    for k, width in enumerate(SEGMENTS):
        v = F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)
        entry = lambda x, looks, k=k: F.struct(x.bitwiseOR(k << 32).alias("key"), F.lit(looks).cast("tinyint").alias("looks"))
        out.append(entry(v, 0))
        out += [F.when(v.bitwiseAND(1 << b) == 0, entry(v.bitwiseOR(1 << b), 1)) for b in range(width)]
        low += width
    return points.select("fp", F.explode(F.array_compact(F.array(*out))).alias("e")).select("e.key", "fp", "e.looks")


def _forest(fps: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among ``fps``: each walk compares with what is not yet reached only."""
    out, left = [], np.unique(fps)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= limit
            if near.any():
                new = left[near]
                out.append((np.full(len(new), x), new))
                frontier.extend(new)
                left = left[~near]
    return out


def _verify(limit: int):
    """Rows sorted by group g; emits verified links u, v. Holds one group at a time, and groups have a bounded size."""

    def links(g: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cut = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[cut, len(g)])
        few = np.repeat(size <= 8, size)
        gs, fs = g[few], fp[few]
        for s in range(1, 8):
            ok = (gs[s:] == gs[:-s]) & (fs[s:] != fs[:-s]) & (np.bitwise_count(fs[s:] ^ fs[:-s]) <= limit) if len(gs) > s else np.zeros(0, bool)
            if ok.any():
                yield fs[:-s][ok], fs[s:][ok]
        for at, n in zip(cut[size > 8].tolist(), size[size > 8].tolist()):
            yield from _forest(fp[at : at + n], limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(upto_last: bool) -> Iterator[pa.RecordBatch]:
            g, fp = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            end = int(np.searchsorted(g, g[-1])) if upto_last else len(g)
            held[:] = [(g[end:], fp[end:])] if end < len(g) else []
            found = list(links(g[:end], fp[:end])) if end else []
            if found:
                u, v = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
                if held[-1][0][-1] != held[0][0][0]:
                    yield from flush(True)
        if held:
            yield from flush(False)

    return run


def _compared(dealt: DataFrame, limit: int) -> DataFrame:
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(_verify(limit), "u long, v long").distinct()


def fingerprint_links(points: DataFrame, max_distance: int = 4, block: int = 4096) -> DataFrame:
    """u, v: links between distinct fingerprints of at most ``max_distance`` bits that keep every component whole."""
    if max_distance > 2 * len(SEGMENTS) - 1:
        raise ValueError("balls of radius one reach no further")
    filed = _filed(points)
    counts = filed.groupBy("key").agg(F.count(F.when(F.col("looks") == 0, 1)).alias("t"), F.count(F.when(F.col("looks") == 1, 1)).alias("p"))
    hot = checkpointed(counts.where((F.col("t") > 0) & ((F.col("t") > block) | (F.col("p") > block))))
    if hot.isEmpty():  # every entry is one group
        return _compared(filed.select(F.col("key").alias("g"), "fp"), max_distance)
    met = filed.join(hot, "key", "left").select("key", "fp", "looks", F.coalesce(F.ceil(F.col("t") / block), F.lit(1)).cast("int").alias("tb"), F.coalesce(F.ceil(F.col("p") / block), F.lit(1)).cast("int").alias("pb"))
    # An entry of ordinary size is one group. A hot one is dealt as pairs of blocks: filed i with filed j >= i, filed i with looking j.
    mine = F.when(F.col("looks") == 0, F.pmod(F.xxhash64("fp"), F.col("tb"))).otherwise(F.pmod(F.xxhash64("fp"), F.col("pb"))).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    filed_pairs = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("tb") - 1), lambda x: F.when(x < F.col("mine"), pair(x, F.col("mine"))).otherwise(pair(F.col("mine"), x))),
        F.when(F.col("pb") > 0, F.transform(F.sequence(F.col("tb"), F.col("tb") + F.greatest(F.col("pb"), F.lit(1)) - 1), lambda x: pair(F.col("mine"), x))).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
    )
    looking_pairs = F.transform(F.sequence(F.lit(0), F.col("tb") - 1), lambda x: pair(x, F.col("tb") + F.col("mine")))
    one = F.array(pair(F.lit(0), F.lit(0)))
    places = F.when((F.col("tb") == 1) & (F.col("pb") <= 1), one).when(F.col("looks") == 0, filed_pairs).otherwise(looking_pairs)
    dealt = met.withColumn("mine", mine).select("key", "fp", F.explode(places).alias("at")).select(F.xxhash64("key", "at.i", "at.j").alias("g"), "fp")
    return _compared(dealt, max_distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, words_per_shingle: int = 4, block: int = 4096) -> DataFrame:
    """One row per input row: doc_id, th, fp long, fingerprint (16 hex digits), component_id, n_links.

    ``component_id`` is the smallest doc_id reachable over links of at most ``max_distance`` bits; n_links counts the
    verified links of the fingerprint that the spanning forests hold.
    """
    marks = checkpointed(fingerprints(docs, id_col, text_col, words_per_shingle))
    points = checkpointed(marks.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")))
    found = checkpointed(fingerprint_links(points.select("fp"), max_distance, block))
    # Nodes are fingerprints, with or without an id: a fingerprint that names nothing may hold its component together.
    roots = connected_components(found)
    grouped = checkpointed(points.join(roots, points["fp"] == roots["node"], "left").select("fp", "rep", "n_rows", F.coalesce("root", "fp").alias("root")))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    degree = found.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    of_fp = checkpointed(grouped.join(least, "root").select("fp", "n_rows", "component_id").join(degree, "fp", "left"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_per_key(marks, of_fp, "fp", "n_rows", marks.count()).select("doc_id", "th", "fp", hexed, "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_group(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component: the row with its smallest doc_id.

    Of rows that share this id the one with the smallest text hash stays; of a component without any id one row per
    fingerprint stays. All columns are kept as they are, whatever they are called.
    """
    t, i, h, n = fresh(docs.columns, "t", "i", "h", "n")
    marks = near_duplicates(docs, **how)
    stay = marks.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min("th").alias(h))
    stay = stay.select(F.col("component_id").alias(i), h).distinct()
    same = Window.partitionBy("doc_id", t).orderBy(*[F.col(c) for c in ("lang", "source") if c in docs.columns] or [F.lit(1)])
    base = docs.withColumn(t, F.xxhash64("text"))
    joined = base.join(stay, base["doc_id"].eqNullSafe(F.col(i)) & (F.col(t) == F.col(h)), "left_semi")
    return joined.withColumn(n, F.row_number().over(same)).where(F.col(n) == 1).select(*docs.columns)

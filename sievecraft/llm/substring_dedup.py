"""Substring deduplication by Rabin-Karp hashes of every window of 13 words.

A window is ``window`` consecutive words of a document; a word is removed if a window covers it whose words also start
in a document with a smaller doc_id. Every window gets a Rabin-Karp hash (a polynomial over 64-bit word hashes, modulo
2^64, from which a second polynomial gives the bucket), and windows with the same hash meet in one bucket.

Moving the windows is what costs. They move as packed rows, one for each bucket and million words: 7 bytes of hash and,
as the windows of a row are ordered by document and place, about one and a half bytes for both of these. The bucket
adds its own bits to the hash: with B buckets a window is told apart by 56 + log2(B) bits (70 bits over 30 GB).
Windows that repeat within a million words are settled before the shuffle, and only the smallest document's go on, so
a passage in a third of all documents sends one entry per million words.

The number of buckets follows the bytes of text, so that a task holds about ``BUCKET`` windows at a time at any size.

Defined results: a null text has no words. Places belong to rows: rows that share a doc_id take nothing from each
other, and what is removed from one stays in the others. Rows without a doc_id are smaller and larger than none: they
keep their words and take none from others. Rows repeated in full get equal rows; an empty table gives an empty result;
other columns are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.session import checkpointed

_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SLAB = 1 << 20
#: Windows that a bucket holds at most, about, and the least bytes a window stands for.
BUCKET, BYTES = 1 << 21, 4


def word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        h = memo.get(w)
        if h is None:
            if len(memo) > 500_000:
                memo.clear()
            h = memo[w] = digest(w)
        out.append(h)
    return np.array(out, np.uint64)


def rabin_karp(h: np.ndarray, window: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each run of ``window`` values, by doubling: hashes of 2k values from two of k."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, acc, width, power = 0, np.zeros(n, np.uint64), 1, base
    run = h
    with np.errstate(over="ignore"):
        while True:
            if window & width:  # the part of this width is appended after what is done
                acc = acc * power + run[done : done + n]
                done += width
            if 2 * width > window:
                return acc
            run = run[:-width] * power + run[width:]
            power, width = power * power, 2 * width


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1)


def _pack(h: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> bytes:
    """Entries sorted by row (doc and tag) and place, as hash planes and zstd-packed steps of doc and place.

    Tags are written only where one is set.
    """
    first = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    step = np.where(first, pos, np.r_[0, np.diff(pos)])
    new = np.flatnonzero(first)
    body, tags = _planes(h, 7), tag[new] if tag.any() else tag[:0]
    docs = np.diff(np.r_[0, doc[new]]).view(np.uint64)
    side = zstandard.ZstdCompressor(level=1).compress(_planes(step.astype(np.uint64), 4) + _planes(docs, 8) + _planes(np.diff(np.r_[new, len(doc)]).astype(np.uint64), 4) + tags.tobytes())
    return np.array([len(h), len(doc), len(new)], "<u4").tobytes() + body + side


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    hashes, n, d = np.frombuffer(b, "<u4", 3).tolist()
    h = _unplanes(b[12 : 12 + 7 * hashes], 7)
    side = zstandard.ZstdDecompressor().decompress(b[12 + 7 * hashes :])
    step, docs, count = _unplanes(side[: 4 * n], 4).view(np.int64), _unplanes(side[4 * n : 4 * n + 8 * d], 8).view(np.int64), _unplanes(side[4 * n + 8 * d : 4 * n + 12 * d], 4).view(np.int64)
    tags = np.frombuffer(side[4 * n + 12 * d :], np.int64)
    doc, tag, total = np.repeat(np.cumsum(docs), count), np.repeat(tags, count) if len(tags) else np.zeros(n, np.int64), np.cumsum(step)
    starts = np.cumsum(count) - count
    return h, doc, tag, total - np.repeat(total[starts] - step[starts], count)


def _later(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries share their hash with an entry of a smaller document."""
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], doc[order]
    cut = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    least = np.repeat(np.minimum.reduceat(ds, cut), np.diff(np.r_[cut, len(hs)]))
    out = np.zeros(len(h), bool)
    out[order] = ds > least
    return out


def _by_row(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos = doc[order], tag[order], pos[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else []
    for a, b in zip(cut, np.r_[cut[1:], len(doc)] if len(doc) else []):
        yield int(doc[a]), int(tag[a]), pos[a:b].astype("<u4").tobytes()


def _windows(window: int, buckets: int):
    """Packed windows by bucket, and places (doc_id, tag, positions) that are settled already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            n = [len(x[0]) for x in held]
            h, b, pos = (np.concatenate([x[k] for x in held]) for k in (0, 1, 4))
            doc, tag = (np.repeat(np.array([x[k] for x in held], np.int64), n) for k in (2, 3))
            held.clear()
            late = _later(h, doc)
            rows = [(d % buckets, d, g, p) for d, g, p in _by_row(doc[late], tag[late], pos[late])]
            h, b, doc, tag, pos = (x[~late] for x in (h, b, doc, tag, pos))
            order = np.lexsort((pos, tag, doc, b) if tag.any() else (pos, doc, b))
            h, b, doc, tag, pos = (x[order] for x in (h, b, doc, tag, pos))
            cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            rows += [(int(b[x]), None, None, _pack(h[x:y], doc[x:y], tag[x:y], pos[x:y])) for x, y in zip(cut, np.r_[cut[1:], len(b)])]
            for at in range(0, len(rows), 256):
                part = list(zip(*rows[at : at + 256]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.binary())], names=["bucket", "doc_id", "tag", "body"])

        size = 0
        for batch in batches:
            for d, g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (t.as_py() or "").encode("utf-8", "replace").split()
                for at in range(0, len(words) - window + 1, _SLAB):  # very long texts go piece by piece
                    wh = word_hashes(words[at : at + _SLAB + window - 1], memo)
                    h = rabin_karp(wh, window, _BASE)
                    b = (_mixed(rabin_karp(wh, window, _BASE2)) % np.uint64(buckets)).astype(np.int32)
                    held.append((_mixed(h) & np.uint64((1 << 56) - 1), b, d, g, np.arange(at, at + len(h), dtype=np.int64)))
                    size += len(h)
                    if size >= _SLAB:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    return run


def _repeated(parts: int):
    """Rows sorted by bucket: places whose window starts in a smaller document too, packed by bucket of the document.

    Holds one bucket at a time, and at most about a million places to send.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], []
        size = 0

        def settle() -> None:
            h, doc, tag, pos = (np.concatenate([x[k] for x in held]) for k in range(4))
            held.clear()
            late = _later(h, doc)
            found.append((doc[late], tag[late], pos[late]))

        def send() -> Iterator[pa.RecordBatch]:
            doc, tag, pos = (np.concatenate([x[k] for x in found]) for k in range(3))
            found.clear()
            to = (_mixed(doc.view(np.uint64) ^ tag.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((pos, tag, doc, to))
            doc, tag, pos, to = doc[order], tag[order], pos[order], to[order]
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            rows = [(int(to[x]), _pack(np.zeros(0, np.uint64), doc[x:y], tag[x:y], pos[x:y])) for x, y in zip(cut, np.r_[cut[1:], len(to)])]
            if rows:
                at, body = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(body, pa.binary())], names=["part", "body"])

        for batch in batches:
            for bucket, doc, tag, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if bucket != now and held:
                    settle()
                    size += len(found[-1][0])
                now = bucket
                if doc is None:
                    held.append(_unpack(body.as_py()))
                else:
                    pos = np.frombuffer(body.as_py(), "<u4").astype(np.int64)
                    found.append((np.full(len(pos), doc, np.int64), np.full(len(pos), tag, np.int64), pos))
                    size += len(pos)
                if size >= _SLAB:
                    yield from send()
                    size = 0
        if held:
            settle()
        if found:
            yield from send()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document bucket: one row for each row of the input with its places. Holds one bucket at a time."""
    now, held = None, []

    def settle() -> Iterator[pa.RecordBatch]:
        rows = list(_by_row(*(np.concatenate([x[k] for x in held]) for k in (1, 2, 3))))
        held.clear()
        if rows:
            d, g, p = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(g, pa.int64()), pa.array(p, pa.binary())], names=["doc_id", "tag", "places"])

    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            if part != now and held:
                yield from settle()
            now = part
            held.append(_unpack(body.as_py()))
    if held:
        yield from settle()


def spans_of(places: bytes, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of words that the windows at these places cover."""
    pos = np.unique(np.frombuffer(places, "<u4").astype(np.int64))
    gap = np.flatnonzero(np.diff(pos) > window)
    return list(zip(pos[np.r_[0, gap + 1]].tolist(), (pos[np.r_[gap, len(pos) - 1]] + window).tolist()))


def _cut_out(window: int):
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept, spans = [], [], [], []
            for t, places in zip(b.column(1), b.column(2)):
                words = (t.as_py() or "").encode("utf-8", "replace").split()
                cut = spans_of(places.as_py(), window) if places.is_valid else []
                parts, at = [], 0
                for s, e in cut:
                    parts += words[at:s]
                    at = e
                parts += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(parts))
                kept.append(b" ".join(parts))
                spans.append([{"start": s, "end": e} for s, e in cut])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return run


def tagged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(doc_id, tag, text of every row; bytes of all texts). The tag tells rows of one doc_id apart.

    It is the hash of the text where unequal texts share a doc_id, and 0 elsewhere, where it would only cost space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    th = F.xxhash64("text")
    ids = checkpointed(rows.groupBy("doc_id").agg(F.min(th).alias("low"), F.max(th).alias("high"), F.sum(F.octet_length("text")).alias("bytes")))
    size = ids.agg(F.sum("bytes")).first()[0] or 0
    shared = ids.where("doc_id is not null and low < high").select("doc_id", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("tag"), "text"), size
    return rows.join(shared, "doc_id", "left").select("doc_id", F.when(F.col("shared"), th).otherwise(0).alias("tag"), "text"), size


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, buckets: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, spans (removed word intervals), kept_text (words by one space)."""
    picked, size = tagged(docs, id_col, text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(4 * parts, -(-size // (BYTES * BUCKET)))
    parts = max(parts, -(-buckets // 64))
    packed = picked.where("doc_id is not null").mapInArrow(_windows(window, buckets), "bucket int, doc_id long, tag long, body binary")
    places = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated(buckets), "part int, body binary")
    gone = places.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_gathered, "doc_id long, tag long, places binary")
    # Rows without a doc_id meet nothing. A hot id is split by the skew join.
    return picked.join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "places").mapInArrow(_cut_out(window), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")

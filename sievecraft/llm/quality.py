"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from each whole text in one pass and written to the checkpoint folder, so that text is read once.
Trees are fitted in numpy on the driver, on at most about ``MAX_ROWS`` labelled rows (chosen by a hash of their ids),
and flattened into arrays, one row per tree; scoring walks all rows down one tree level at a time.

Defined results: null and empty texts have statistics and a score like others; rows without an id are held out and not
learned from; labels without a document are ignored, several labels of a document all count; without any label every
score is 0.5; an empty table gives an empty result; other columns are not read, whatever they are called. Ids,
languages, sources and labels are no inputs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.batches import short_batches
from sievecraft.session import checkpointed

#: Bound of the labelled rows that are gathered for fitting.
MAX_ROWS = 40_000
#: Places of a row by the hash of its id; the share to learn from is taken in units of one of them.
FINE = 1 << 52
STATISTICS = (
    "log_words", "log_bytes", "word_bytes", "distinct_words", "top_word", "doubled_words", "upper_ascii", "upper_any", "digits", "white", "stops", "marks",
    "shouts", "noise", "bars", "log_lines", "repeated_lines", "repeated_line_bytes", "line_words", "short_lines", "log_longest", "entropy", "noise_ends",
    "stops_per_word", "high_bytes", "distinct_pairs", "packed", "plain_ends",
)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_STOPS, _NOISE = np.frombuffer(b".,;:?", np.uint8), np.frombuffer(b"#$%&*@^~<>=+{}[]\\", np.uint8)
_ENDS = frozenset(b".,;:?!")


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = len(words) or 1
    letters = int(c[_UPPER].sum() + c[_LOWER].sum()) or 1
    lower = text.lower()
    changed = 0.0
    if text and len(lower) != len(text):  # a few letters become two when lowered
        changed = sum(x != x.lower() for x in text) / len(text)
    elif text:
        changed = float((np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)).mean())
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x]
    seen = Counter(lines)
    again = [(x, k) for x, k in seen.items() if k > 1]
    m = n or 1
    p = c[c > 0] / m
    ends = Counter(x[-1] for x in words)
    plain = sum(v for k, v in ends.items() if k in _ENDS)
    alnum = sum(v for k, v in ends.items() if k >= 128 or chr(k).isalnum())
    return [
        math.log1p(len(words)), math.log1p(n), sum(map(len, words)) / w, len(counts) / w, max(counts.values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, c[_UPPER].sum() / letters, changed, c[_DIGIT].sum() / m, (c[32] + c[9:14].sum()) / m,
        c[_STOPS].sum() / m, c[_MARKS].sum() / m, c[33] / m, c[_NOISE].sum() / m, c[124] / m, math.log1p(len(lines)),
        sum(k - 1 for _, k in again) / (len(lines) or 1), sum(len(x) * (k - 1) for x, k in again) / m, len(words) / (len(lines) or 1),
        sum(len(x) < 16 for x in lines) / (len(lines) or 1), math.log1p(max(map(len, words), default=0)), float(-(p * np.log2(p)).sum()),
        (len(words) - plain - alnum) / w, c[46] / w, c[128:].sum() / m, pairs / w, len(zlib.compress(raw, 1)) / m, plain / w,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of STATISTICS) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], names=["doc_id", "x"])

    return short_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Trees:
    """Flattened trees: node k of a tree has children 2k+1 and 2k+2; rows go right where the statistic exceeds ``cut``."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes)
    value: np.ndarray  # (trees, leaves)
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(math.log2(self.value.shape[1])) if len(self.value) else 0
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 1.0, least: float = 4.0) -> Trees:
    """Boost logistic loss; splits are sought over ``bins`` quantile bins of each statistic."""
    inner = 2**depth - 1
    if not len(y):
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    start = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            local = at - base
            gs = np.bincount(local, g, width)
            hs = np.bincount(local, h, width)
            best = np.full(width, 1e-6)
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * bins + binned[:, k]
                gl = np.cumsum(np.bincount(cell, g, width * bins).reshape(width, bins), axis=1)[:, : len(e)]
                hl = np.cumsum(np.bincount(cell, h, width * bins).reshape(width, bins), axis=1)[:, : len(e)]
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (gs**2 / (hs + ridge))[:, None]
                gain[(hl < least * 0.05) | (hr < least * 0.05)] = 0
                j = gain.argmax(axis=1)
                top = gain[np.arange(width), j]
                for node in np.flatnonzero(top > best):
                    best[node] = top[node]
                    feature[t, base + node], cut[t, base + node] = k, e[j[node]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[t, at]] > cut[t, at])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[t][leaf]
    return Trees(feature, cut, value, start)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def fit_quality(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **how) -> Trees:
    """Fit on labelled rows outside the held-out fifth, about ``max_rows`` at most, chosen by a hash of the id."""
    learn = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    learn = learn.where(remainder(F.col("doc_id"), 5) != 0)
    share = max_rows / max(learn.count(), 1)
    if share < 1:
        learn = learn.where(F.pmod(F.xxhash64("doc_id"), F.lit(FINE)) < int(share * FINE))
    rows = stats.where("doc_id is not null").join(learn, "doc_id").select("doc_id", "x", "y").toPandas().sort_values(["doc_id", "y"], kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return fit_trees(x, (rows["y"].to_numpy(float) > 0).astype(float), **how)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    stats = checkpointed(document_statistics(docs, id_col, text_col))
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(stats, labels, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(x))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

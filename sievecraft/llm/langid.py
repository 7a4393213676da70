"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character 4-grams: interpolated Kneser-Ney down to single characters and the uniform
distribution. Letters are folded to lower case, every run of other characters is one space. The models of all
languages are stored together: for each order one sorted array of gram hashes with a log probability per language, all
lower orders interpolated in already, also for the languages that lack the gram; and one of contexts with the weights
of the lower order. So a place is settled by the longest gram that any language has. A text gets the language with the
lowest cross-entropy per character.

Models are fitted on a bounded sample: whole texts of at most about ``MAX_DOCS`` documents and ``MAX_CHARS`` characters
per language (``ALL_CHARS`` for all languages together), chosen by a hash of the id among the rows to learn from,
and one document at least of each language, so every language is learned at any size. A
sixth of them calibrates instead of counting: the temperature of the score, and for each language how far above its
mean the cross-entropy of its own texts goes. That distance shrinks with the root of a text's length, so the limit
beyond which a text is rejected as none of the learned languages is a function of its length and holds for all texts.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; rows without an id or a
language are not learned from; without rows to learn from everything is ``und``; an empty table gives an empty result;
columns of the input named lang_pred, lang_score or rejected are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.batches import short_batches
from sievecraft.llm.quality import remainder

MAX_DOCS, MAX_CHARS, ALL_CHARS = 800, 8_000_000, 64_000_000
#: Places of a document by the hash of its id; shares are taken in units of one of them.
FINE = 1 << 52
ORDER = 4
#: Symbols that are settled together.
PLACES = 1 << 18
UND = "und"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _OTHER = 1, 2


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of every code point: 0 none, 1 space (what is no letter), 2 a letter that was never learned, then the learned letters."""
    out = np.full(0x110000, _SPACE, np.uint32)
    out[[c for c in range(0x110000) if chr(c).isalpha()]] = _OTHER
    seen = sorted({c for t in texts for c in set(t.lower()) if c.isalpha()})
    for k, c in enumerate(seen):
        for form in {c, c.upper(), c.title()}:
            if len(form) == 1:
                out[ord(form)] = 3 + k
    return out


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    s = table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    s = np.concatenate(([_SPACE], s, [_SPACE])).astype(np.uint64)
    return s[np.r_[True, (s[1:] != _SPACE) | (s[:-1] != _SPACE)]]


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each place from the second on; places without enough symbols before start with 0."""
    padded = np.concatenate((np.zeros(order - 1, np.uint64), s))
    h = np.zeros(len(s), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ (padded[k : k + len(s)] + np.uint64(1))) * _MULT
            h ^= h >> np.uint64(29)
    return h[1:]


def contexts(s: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order - 1`` symbols before each place from the second on."""
    return grams(np.concatenate((np.zeros(1, np.uint64), s)), order - 1)[: len(s) - 1] if order > 1 else np.zeros(len(s) - 1, np.uint64)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def counted(parts: list[np.ndarray], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Occurrences of each different gram of the highest order, and by order the hashes of its grams and contexts.

    Texts are counted about ``PLACES`` symbols at a time. Lower orders need no places of their own: a gram of any order
    is the end of one of the highest.
    """
    found: list[tuple[np.ndarray, ...]] = []
    held: list[np.ndarray] = []
    size = 0
    for j, p in enumerate(parts):
        held += [np.zeros(order, np.uint64), p]
        size += len(p)
        if size < PLACES and j + 1 < len(parts):
            continue
        joined = np.concatenate(held)
        real = np.flatnonzero(joined[1:])  # places that hold a symbol
        _, at, count = np.unique(grams(joined, order)[real], return_index=True, return_counts=True)
        at = real[at]
        found.append((count, *[grams(joined, k)[at] for k in range(1, order + 1)], *[contexts(joined, k)[at] for k in range(1, order + 1)]))
        held, size = [], 0
    if not found:
        empty = [np.zeros(0, np.uint64)] * order
        return np.zeros(0, np.int64), empty, empty
    columns = [np.concatenate([f[i] for f in found]) for i in range(1 + 2 * order)]
    _, at, which = np.unique(columns[order], return_index=True, return_inverse=True)
    count = np.bincount(which, columns[0]).astype(np.int64)
    columns = [c[at] for c in columns]
    return count, columns[1 : order + 1], columns[order + 1 :]


@dataclass
class Models:
    langs: list[str]
    table: np.ndarray
    keys: list[np.ndarray]  # by order - 1: sorted gram hashes
    logp: list[np.ndarray]  # (grams, languages)
    back_keys: list[np.ndarray]  # by order - 1: sorted context hashes
    back: list[np.ndarray]  # (contexts, languages): log of the weight of the lower order
    floor: float
    temperature: float = 1.0
    usual: np.ndarray | None = None  # mean cross-entropy of each language's own texts
    spread: np.ndarray | None = None  # the most that they exceed it by, times the root of their length
    margin: float = 0.0

    def log_probabilities(self, s: np.ndarray) -> np.ndarray:
        """(places, languages)"""
        out = np.zeros((len(s) - 1, len(self.langs)))
        todo = np.arange(len(s) - 1)
        carry = np.zeros((1, len(self.langs)))
        for order in range(len(self.keys), 0, -1):
            at, hit = _lookup(self.keys[order - 1], grams(s, order)[todo])
            out[todo[hit]] = self.logp[order - 1][at[hit]] + (carry[hit] if len(carry) == len(todo) else carry)
            miss = ~hit
            carry, todo = carry[miss] if len(carry) == len(todo) else np.zeros((int(miss.sum()), len(self.langs))), todo[miss]
            if not len(todo):
                return out
            bat, bhit = _lookup(self.back_keys[order - 1], contexts(s, order)[todo])
            carry = carry + np.where(bhit[:, None], self.back[order - 1][bat], 0.0)
        out[todo] = self.floor + carry
        return out

    def _long(self, s: np.ndarray) -> np.ndarray:
        """Sum of the log probabilities of one long text, slab by slab; each slab brings the symbols its first places look back on."""
        total = np.zeros(len(self.langs))
        for at in range(1, len(s), PLACES):
            base = max(0, at - ORDER)
            total += self.log_probabilities(s[base : at + PLACES])[at - base - 1 :].sum(axis=0)
        return total

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy in nats per character (texts, languages), characters counted, whether there is a letter.

        Whole texts are joined up to ``PLACES`` symbols and settled together; no more than these are held at once.
        """
        n, letter, ce = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool), np.zeros((len(texts), len(self.langs)))
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        gap = np.zeros(ORDER, np.uint64)

        def settle() -> None:
            lp = self.log_probabilities(np.concatenate([x for _, p in held for x in (gap, p)]))
            start = ORDER
            for k, p in held:
                if len(p) > 1:
                    ce[k] = -lp[start : start + len(p) - 1].mean(axis=0)
                start += len(p) + ORDER
            held.clear()

        for k, t in enumerate(texts):
            p = symbols(t, self.table)
            n[k], letter[k] = len(p) - 1, bool((p >= _OTHER).any())
            if len(p) > PLACES:
                ce[k] = -self._long(p) / n[k]
                continue
            if held and size + len(p) > PLACES:
                settle()
                size = 0
            held.append((k, p))
            size += len(p)
        if held:
            settle()
        return ce, n, letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, whether it is rejected."""
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        ce, n, letter = self.entropies([t or "" for t in texts])
        z = -ce * np.minimum(n, 200)[:, None] / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        best = ce.argmin(axis=1)
        score = np.where(letter, z[np.arange(len(texts)), best] / z.sum(axis=1), 0.0)
        rejected = ~letter | (ce[np.arange(len(texts)), best] > self.usual[best] + self.margin + self.spread[best] / np.sqrt(np.maximum(n, 1)))
        return [self.langs[k] if ok else UND for k, ok in zip(best, letter)], score, rejected


def fit_models(samples: dict[str, list[str]], order: int = ORDER, discount: float = 0.75, margin: float = 0.35) -> Models:
    """Count, interpolate and calibrate; ``samples`` has whole texts by language."""
    langs = sorted(samples)
    table = alphabet([t for x in samples.values() for t in x])
    held = {x: [t for k, t in enumerate(samples[x]) if k % 6 == 5] for x in langs}
    size = int(table.max()) + 1
    uniform = 1.0 / size
    per_order: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    links: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    per_back: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for x in langs:
        parts = [symbols(t, table) for k, t in enumerate(samples[x]) if k % 6 != 5]
        times, whole, ctx = counted(parts, order)
        whole, ctx = [None, *whole], [None, *ctx]
        lower = np.array([], np.float64)
        lower_keys = np.array([], np.uint64)
        for k in range(1, order + 1):
            if k == order:
                keys, first = np.unique(whole[k], return_index=True)
                count = times[first]
            else:  # Kneser-Ney: of a lower order count the different symbols before, not the occurrences
                _, at = np.unique(whole[k + 1], return_index=True)
                keys, sub, count = np.unique(whole[k][at], return_index=True, return_counts=True)
                first = at[sub]
            own = ctx[k][first]
            ckeys, cat = np.unique(own, return_inverse=True)
            total, kinds = np.bincount(cat, count), np.bincount(cat)
            weight = discount * kinds / total
            if k == 1:
                below = np.full(len(keys), uniform)
            else:
                at, hit = _lookup(lower_keys, whole[k - 1][first])
                below = np.where(hit, lower[at], uniform)
            prob = np.maximum(count - discount, 0) / total[cat] + weight[cat] * below
            per_order[k - 1].append((keys, np.log(prob)))
            links[k - 1].append((keys, own, whole[k - 1][first] if k > 1 else own))
            per_back[k - 1].append((ckeys, np.log(weight)))
            lower, lower_keys = prob, keys

    def joined_rows(parts: list[tuple[np.ndarray, np.ndarray]], empty: float) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint64)
        rows = np.full((len(keys), len(parts)), empty)
        for j, (ks, v) in enumerate(parts):
            rows[np.searchsorted(keys, ks), j] = v
        return keys, rows

    orders, backs = [joined_rows(p, np.nan) for p in per_order], [joined_rows(p, 0.0) for p in per_back]
    for k in range(1, order + 1):  # a language without the gram backs off, once and for all
        keys, rows = orders[k - 1]
        ctx, below = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for ks, c, b in links[k - 1]:
            at = np.searchsorted(keys, ks)
            ctx[at], below[at] = c, b
        bat, bhit = _lookup(backs[k - 1][0], ctx)
        weight = np.where(bhit[:, None], backs[k - 1][1][bat], 0.0)
        lower = orders[k - 2][1][_lookup(orders[k - 2][0], below)[0]] if k > 1 else np.log(uniform)
        np.copyto(rows, weight + lower, where=np.isnan(rows))

    out = Models(langs, table, [k for k, _ in orders], [v for _, v in orders], [k for k, _ in backs], [v for _, v in backs], float(np.log(uniform)), 1.0, np.zeros(len(langs)), np.full(len(langs), np.inf), margin)
    texts = [(j, t) for j, x in enumerate(langs) for t in held[x]]
    if texts:
        ce, n, letter = out.entropies([t for _, t in texts])
        gold = np.array([j for j, _ in texts])
        losses = []
        for temperature in (2.0, 5.0, 10.0, 20.0, 40.0, 80.0):
            z = -ce * np.minimum(n, 200)[:, None] / temperature
            z -= z.max(axis=1, keepdims=True)
            losses.append((float(-(z[np.arange(len(gold)), gold] - np.log(np.exp(z).sum(axis=1)))[letter].mean()) if letter.any() else 0.0, temperature))
        out.temperature = min(losses)[1]
        for j in range(len(langs)):
            mine = letter & (gold == j)
            if mine.any():
                out.usual[j] = np.average(ce[mine, j], weights=n[mine])
                out.spread[j] = max(0.0, float(((ce[mine, j] - out.usual[j]) * np.sqrt(n[mine])).max()))
    return out


def fit_language_models(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, all_chars: int = ALL_CHARS) -> Models:
    """Learn from rows whose crc32(doc_id) mod 4 is not 2; the sample that reaches the driver is bounded as said above."""
    learn = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    learn = learn.where(remainder(F.col("doc_id"), 4) != 2)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FINE))
    # Counts per language; a language is a label, and there are at most a few thousand.
    counts = learn.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min(place).alias("first")).collect()
    most = min(max_chars, all_chars / max(len(counts), 1))
    # However small a language's share is, its document with the smallest hash is taken.
    share = {r["lang"]: max(int(FINE * min(1.0, max_docs / r["n"], most / max(r["chars"], 1))), r["first"] + 1) for r in counts}
    if not share:
        return Models([], np.full(0x110000, _SPACE, np.uint32), [], [], [], [], 0.0)
    quota = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in share.items()])
    rows = learn.where(place < quota).select("lang", "doc_id", "text").collect()
    samples: dict[str, list[str]] = {k: [] for k in share}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        samples[r["lang"]].append(r["text"])
    return fit_models({k: v for k, v in samples.items() if v})


def identify_languages(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: all its columns, then lang_pred, lang_score, rejected (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "rejected")]
    names = [f.name for f in fields]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "lang_score", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("rejected", BooleanType())])
    return short_batches(docs).select(*names).mapInArrow(run, schema)

"""Sweeps of posteriors over thousands of configurations in one pass.

What does not depend on a configuration is joined once into one row per query: its base ranking, its answers, and the
components of the posterior (links of the first documents in the co-answer graph; the strongest similarities for each
document; the matching features of its profile). A task evaluates the whole grid on a query's arrays and adds up the
measures by configuration, so that what leaves it is one row per configuration, and the inputs are scanned once however
large the grid is. The graph's sweep, whose grid is the largest, tells apart the configurations that differ on a query
alone, and counts what is ahead of the query's answers in place of sorting.

Scores are rounded to nine digits and equal ones go to the smaller document, as everywhere. A query's documents are
its candidates and fit one row. Queries without an answer do not count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.session import arrow_batches, checkpointed

MISSING, MOST = 100_000, 100  # rank of a document that a list lacks; documents of a list that count
#: The grids of the three posteriors, and the weights of features by their number of words.
GRAPH_GRID = {"seeds": (1, 2, 3, 5, 8, 10), "power": (0.5, 1.0, 1.5, 2.0), "mode": ("conditional", "cosine", "jaccard", "lift"), "min_edge": (1, 2, 3), "alpha": (0.02, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.60, 0.80, 1.0, 1.5, 2.0), "base_k": (0, 5, 20, 40)}
KERNEL_GRID = {"power": (1.0, 1.5, 2.0, 3.0), "word": (0.0, 0.25, 0.5, 0.75, 1.0), "prior": (-0.35, -0.15, 0.0, 0.15, 0.35), "alpha": (0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.65, 0.80, 1.0), "k": (0, 5, 20, 40, 80)}
PROFILE_GRID = {"ngram": (1, 2, 3), "k1": (0.5, 1.2, 2.5), "b": (0.25, 0.75, 1.0), "prior": (-0.3, 0.0, 0.3), "alpha": (0.02, 0.05, 0.08, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50, 0.65, 0.80, 1.0), "k": (0, 2, 5, 10, 20, 40, 80)}
PHRASE_WEIGHTS = (1.0, 1.35, 1.65)
#: Queries that a task of a sweep holds as objects at once; one with a thousand links takes half a megabyte.
BATCH = 64
#: Links of a graph that are broadcast, some 60 bytes each (of a larger one a query's row brings its own); tasks that its queries are dealt into.
GRAPH_LINKS, TASKS_A_CORE = 500_000, 4
#: Documents times the graph's configurations that are held at once, some 30 bytes each; a query with more goes through the grid in parts.
CELLS = 2_000_000
THIRDS = (1.0, 0.40, 0.15)  # what the three strongest similarities of a document count

Scorer = Callable[[dict, dict[int, int], dict], Iterator[np.ndarray]]
Judge = Callable[[dict], np.ndarray | None]
GAIN = 1 / np.log2(np.arange(2, 12))


def places(scores: np.ndarray, most: int) -> np.ndarray:
    """For each row of scores the documents of the first ``most`` places, -1 beyond those that have a score (others: -inf)."""
    n = scores.shape[1]
    shift = max(1, int(n).bit_length())
    here = np.isfinite(scores)
    key = np.where(here, (np.rint(np.where(here, scores, 0.0) * 1e9).astype(np.int64) << shift) | (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
    if n > most:
        key = np.partition(key, n - most, axis=1)[:, n - most :]
    key = np.sort(key, axis=1)[:, ::-1]
    return np.where(key > np.iinfo(np.int64).min, n - 1 - (key & ((1 << shift) - 1)), -1)


def measures(scores: np.ndarray, gold: np.ndarray, answers: int) -> np.ndarray:
    """Recall and precision at 5, nDCG at 10 of each row of scores."""
    top = places(scores, 10)
    hit = np.where(top >= 0, gold[top], False)
    five = hit[:, :5].sum(axis=1)
    return np.stack([five / answers, five / 5, (hit * GAIN[: hit.shape[1]]).sum(axis=1) / GAIN[: min(answers, 10)].sum()], axis=1)


def ranks_of(scores: np.ndarray, most: int = MOST) -> np.ndarray:
    """Rank of each document by one row of scores; MISSING for what is beyond ``most`` or has none."""
    out = np.full(len(scores), float(MISSING))
    top = places(scores[None, :], most)[0]
    top = top[top >= 0]
    out[top] = np.arange(1, len(top) + 1)
    return out


def blends(rank: np.ndarray, base: np.ndarray, alphas: tuple, ks: tuple) -> np.ndarray:
    """Scores of alpha / (k + rank) + (1 - alpha) / (k + base) for every alpha and k, of documents that one of the lists has."""
    a, k = np.array(alphas)[:, None, None], np.array(ks, float)[None, :, None]
    s = a / (k + rank) + (1 - a) / (k + base)
    return np.where((rank < MISSING) | (base < MISSING), s, -np.inf).reshape(len(alphas) * len(ks), -1)


def swept(rows: DataFrame, grid: dict[str, tuple], scorer: Scorer | None = None, judge: Judge | None = None) -> DataFrame:
    """The grid's columns, n, recall5, precision5, ndcg10 of each configuration.

    ``rows`` has qid, base (documents in order), gold and the scorer's columns; the scorer gives, in the grid's order,
    blocks of score rows over the documents, which are numbered by their order. In place of a scorer a judge gives the
    measures of all configurations on a query, None if they are 0.
    """
    shape = tuple(len(v) for v in grid.values())
    whole = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((whole, 3)), 0
        for b in batches:
            for r in b.to_pylist():
                if not r["gold"]:
                    continue
                if judge is not None:
                    found, n = judge(r), n + 1
                    total += 0 if found is None else found
                    continue
                docs = sorted({*r["base"], *r["docs"]})
                at = {x: k for k, x in enumerate(docs)}
                answers = set(r["gold"])
                gold = np.array([x in answers for x in docs], bool)
                start, n = 0, n + 1
                if docs:
                    for s in scorer(r, at, grid):
                        total[start : start + len(s)] += measures(s, gold, len(answers))
                        start += len(s)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(whole, dtype=np.int32)), pa.array(np.full(whole, n)), *[pa.array(total[:, j]) for j in range(3)]], names=["config", "n", "recall", "precision", "ndcg"])

    sums = rows.mapInArrow(run, "config int, n long, recall double, precision double, ndcg double").groupBy("config")
    with arrow_batches(rows.sparkSession, BATCH):  # a row per configuration is written
        out = checkpointed(sums.agg(F.sum("n").alias("n"), *[(F.sum(c) / F.sum("n")).alias(name) for c, name in (("recall", "recall5"), ("precision", "precision5"), ("ndcg", "ndcg10"))]))
    columns, step = [], whole
    for name, values in grid.items():  # a configuration's number counts through the grid, the last column fastest
        step //= len(values)
        columns.append(F.element_at(F.array(*map(F.lit, values)), ((F.floor(F.col("config") / step) % len(values)) + 1).cast("int")).alias(name))
    return out.select(*columns, "n", "recall5", "precision5", "ndcg10")


def best_trials(trials: DataFrame, most: int = 30) -> DataFrame:
    """The ``most`` best configurations by recall, precision and nDCG, with their place; ties in the grid's order."""
    grid = [c for c in trials.columns if c not in ("n", "recall5", "precision5", "ndcg10")]
    order = [*[F.desc(F.round(c, 9)) for c in ("recall5", "precision5", "ndcg10")], *grid]
    return trials.orderBy(*order).limit(most).withColumn("place", F.row_number().over(W.orderBy(*order)))  # ``most`` rows


# ---------------------------------------------------------------- the three posteriors


def _listed(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """qid, base, gold of the queries that have answers."""
    base = ranking.where(F.col("rank") <= MOST).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("base"))
    return gold.groupBy("qid").agg(F.collect_set("doc_id").alias("gold")).join(base, "qid", "left")


def _filled(rows: DataFrame, like: DataFrame, **parts: str) -> DataFrame:
    """Missing arrays as empty ones: base and docs of the type of doc_id, others of the types named."""
    kinds = {"base": "array<" + like.schema["doc_id"].dataType.simpleString() + ">"} | parts
    for name, kind in kinds.items():
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return rows


def base_ranks(r: dict, at: dict) -> np.ndarray:
    out = np.full(len(at), float(MISSING))
    for k, x in enumerate(r["base"]):
        out[at[x]] = k + 1
    return out


def strength(mode: str, count: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How strongly two documents are linked that ``count`` questions share, by the numbers of questions of each."""
    if mode == "conditional":
        return count / (left + 1)
    if mode == "cosine":
        return count / np.sqrt((left + 0.5) * (right + 0.5))
    if mode == "jaccard":
        return count / (left + right - count + 1)
    return count / ((left + 0.5) * (right + 0.5)) ** 0.35


@dataclass(frozen=True)
class Links:
    """Links by their source: documents, where the links of each start, and of a link the target's number, questions, strengths."""

    docs: list
    at: dict
    starts: np.ndarray
    dst: np.ndarray
    count: np.ndarray
    strong: np.ndarray

    @staticmethod
    def of(src: list, dst: list, count: np.ndarray, left: np.ndarray, right: np.ndarray, modes: tuple) -> Links:
        docs = sorted({*src, *dst})
        at = {x: k for k, x in enumerate(docs)}
        source = np.array([at[x] for x in src], np.int64)
        order = np.argsort(source, kind="stable")
        strong = np.array([strength(m, count, left, right) for m in modes]).reshape(len(modes), -1)
        return Links(docs, at, np.searchsorted(source[order], np.arange(len(docs) + 1)), np.array([at[x] for x in dst], np.int64)[order], count[order], strong[:, order])

    def first(self, base: list, most: int) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
        """rank; targets in order, which of them, questions, strengths of the links of the first ``most`` documents."""
        found = [(k + 1, self.starts[self.at[x]], self.starts[self.at[x] + 1]) for k, x in enumerate(base[:most]) if x in self.at]
        rows = np.concatenate([np.arange(a, b) for _, a, b in found] or [np.zeros(0, np.int64)])
        codes, which = np.unique(self.dst[rows], return_inverse=True)
        return np.repeat([float(k) for k, _, _ in found], [b - a for _, a, b in found]), [self.docs[c] for c in codes], which, self.count[rows], self.strong[:, rows]


def _of_row(links: list[dict], modes: tuple) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
    """The same of links that a row brings."""
    count, left, right = (np.array([x[c] for x in links], float) for c in ("cnt", "fs", "fd"))
    docs = sorted({x["dst"] for x in links})
    at = {x: k for k, x in enumerate(docs)}
    strong = np.array([strength(m, count, left, right) for m in modes]).reshape(len(modes), -1)
    return np.array([x["rank"] for x in links], float), docs, np.array([at[x["dst"]] for x in links], np.int64), count, strong


def _graph_judged(base: list, gold: list, grid: dict, rank: np.ndarray, linked: list, which: np.ndarray, count: np.ndarray, strong: np.ndarray) -> np.ndarray | None:
    """Measures of all configurations on a query; a document's score is 1 / (k + base) + alpha * g / (k + 1), g its links' strength over the largest."""
    docs = sorted({*base, *linked})
    at = {x: k for k, x in enumerate(docs)}
    answers, n = {*gold}, len(docs)
    held = [at[x] for x in answers if x in at]
    if not held:
        return None
    for name in ("seeds", "power"):  # the grid's first columns
        if n * len(grid["seeds"]) * len(grid["power"]) * len(grid["mode"]) * len(grid["min_edge"]) > CELLS and len(grid[name]) > 1:
            return np.concatenate([_graph_judged(base, gold, grid | {name: (v,)}, rank, linked, which, count, strong) for v in grid[name]])
    dst, most = np.array([at[x] for x in linked], np.int64)[which], max(grid["seeds"])
    slot, cells = (rank.astype(np.int64) - 1) * n + dst, most * n
    powers, modes, least, seeds = (grid[c] for c in ("power", "mode", "min_edge", "seeds"))
    ok = [(count >= e) & (rank <= most) for e in least]
    by_rank = np.stack([[np.bincount(slot[o], s[o], cells) for o in ok] for s in strong]).reshape(len(modes), len(least), most, n)
    reached = np.stack([np.bincount(slot[o], minlength=cells) for o in ok]).reshape(len(least), most, n).cumsum(axis=1) > 0
    chosen, r = np.array(seeds) - 1, np.arange(1.0, most + 1)[:, None]
    g = np.stack([(by_rank / r**p).cumsum(axis=2)[:, :, chosen] for p in powers])  # power, mode, least, seeds, document
    g = g.transpose(3, 0, 1, 2, 4).reshape(-1, n)
    top = g.max(axis=1, keepdims=True)
    g = g / np.where(top > 0, top, 1.0)
    own = np.full(n, float(MISSING))
    own[[at[x] for x in base]] = np.arange(1, len(base) + 1)
    here = np.broadcast_to(reached.transpose(1, 0, 2)[chosen][:, None, None], (len(seeds), len(powers), len(modes), len(least), n)).reshape(-1, n) | (own < MISSING)
    known: dict[tuple, int] = {}  # on a query many of the graph's configurations are the same
    of = np.array([known.setdefault((a.tobytes(), b.tobytes()), len(known)) for a, b in zip(g, here)])
    one = np.unique(of, return_index=True)[1]
    g, here = np.ascontiguousarray(g[one].T), here[one].T
    alphas, ks = grid["alpha"], np.array(grid["base_k"], float)[:, None, None]
    five, gain = (np.zeros((len(alphas), len(ks), len(one))) for _ in range(2))
    gains, small = np.append(GAIN, 0.0), np.uint8 if n < 256 else np.int32
    # A document that stands no lower and is linked more strongly by this is ahead whatever alpha and k, by more than rounding.
    clear = 3e-9 * (ks.max() + 1) / min(alphas) if min(alphas) > 0 else np.inf
    for x in held:
        more, less = g >= g[x] + clear, g + clear <= g[x]
        some = np.flatnonzero(here[x] & (more[own <= own[x]].sum(axis=0) < 10))  # elsewhere ten are ahead
        if not len(some):
            continue
        rows = np.flatnonzero((own < own[x]) | ~less[:, some].all(axis=1))  # others are behind everywhere
        at_x, kept, seen = np.searchsorted(rows, x), g[np.ix_(rows, some)], here[np.ix_(rows, some)]
        start = 1 / (ks + own[rows][:, None])
        if not seen.all():
            start = start + np.where(seen, 0.0, -np.inf)
        s, ahead = np.empty((len(ks), *kept.shape)), np.empty((len(ks), *kept.shape), bool)
        for i, alpha in enumerate(alphas):
            np.divide(alpha * kept, ks + 1, out=s)
            np.add(start, s, out=s)
            np.multiply(s, 1e9, out=s)
            np.rint(s, out=s)
            mine = s[:, at_x : at_x + 1]
            np.greater_equal(s[:, :at_x], mine, out=ahead[:, :at_x])  # equal ones go to the smaller document
            np.greater(s[:, at_x:], mine, out=ahead[:, at_x:])
            place = np.add.reduce(ahead.view(np.uint8), axis=1, dtype=small)
            five[i][:, some] += place < 5
            gain[i][:, some] += gains[np.minimum(place, 10)]
    five, gain = five[:, :, of].reshape(-1, len(of)).T.ravel(), gain[:, :, of].reshape(-1, len(of)).T.ravel()
    return np.stack([five / len(answers), five / 5, gain / GAIN[: min(len(answers), 10)].sum()], axis=1)


def graph_grid(ranking: DataFrame, edges: DataFrame, freq: DataFrame, gold: DataFrame, grid: dict[str, tuple] = GRAPH_GRID) -> DataFrame:
    """Sweep of the co-answer graph: ranking (qid, doc_id, rank), edges (src, dst, cnt), freq (doc_id, n), gold (qid, doc_id).

    A graph of ``GRAPH_LINKS`` links at most is broadcast; else a query's row brings the links of its first documents.
    """
    e = checkpointed(edges.join(freq.select(F.col("doc_id").alias("src"), F.col("n").alias("fs")), "src").join(freq.select(F.col("doc_id").alias("dst"), F.col("n").alias("fd")), "dst").select("src", "dst", *[F.col(c).cast("long").alias(c) for c in ("cnt", "fs", "fd")]))
    listed, most = _listed(ranking, gold), max(grid["seeds"])
    if e.count() <= GRAPH_LINKS:
        held = e.toArrow()
        shared = e.sparkSession.sparkContext.broadcast(Links.of(held["src"].to_pylist(), held["dst"].to_pylist(), *[held[c].to_numpy().astype(float) for c in ("cnt", "fs", "fd")], grid["mode"]))
        parts = TASKS_A_CORE * e.sparkSession.sparkContext.defaultParallelism  # rows are small, and by their bytes would land in few tasks
        return swept(_filled(listed, ranking).select("qid", "base", "gold").repartition(parts, "qid"), grid, judge=lambda r: _graph_judged(r["base"], r["gold"], grid, *shared.value.first(r["base"], most)))
    first = ranking.where(F.col("rank") <= most).select("qid", F.col("doc_id").alias("src"), "rank")
    links = first.join(e, "src").groupBy("qid").agg(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), "dst", "cnt", "fs", "fd")).alias("links"))
    kind = ranking.schema["doc_id"].dataType.simpleString()
    rows = _filled(listed.join(links, "qid", "left"), ranking, links=f"array<struct<rank:bigint,dst:{kind},cnt:bigint,fs:bigint,fd:bigint>>")
    return swept(rows.select("qid", "base", "gold", "links"), grid, judge=lambda r: _graph_judged(r["base"], r["gold"], grid, *_of_row(r["links"], grid["mode"])))


def _kernel_scores(r: dict, at: dict, grid: dict) -> Iterator[np.ndarray]:
    base, parts = base_ranks(r, at), r["parts"]
    slot = np.array([at[x["doc_id"]] for x in parts], np.int64)
    word, char = (np.array([[*x[c], 0.0, 0.0, 0.0][:3] for x in parts], float).reshape(-1, 3) for c in ("word", "char"))
    prior = np.array([x["prior"] for x in parts], float)
    for power in grid["power"]:
        w, c = ((np.where(v > 0, v, 0) ** power) @ np.array(THIRDS) for v in (word, char))
        w, c = (v / (v.max() if v.size and v.max() > 0 else 1.0) for v in (w, c))
        for mix, pp in product(grid["word"], grid["prior"]):
            s = np.full(len(at), -np.inf)
            s[slot] = (mix * w + (1 - mix) * c) * prior**pp
            yield blends(ranks_of(s), base, grid["alpha"], grid["k"])


def kernel_grid(word: DataFrame, char: DataFrame, labels: DataFrame, ranking: DataFrame, gold: DataFrame, grid: dict[str, tuple] = KERNEL_GRID, depth: int = 400) -> DataFrame:
    """Sweep of the kernel posterior: word and char (qid, other, sim), labels (qid, doc_id) of the questions to learn from.

    Of each channel the ``depth`` nearest questions count; a document's prior is (n + 0.5) / (largest n + 0.5), n being
    the number of questions that it answers.
    """
    votes = labels.select(F.col("qid").alias("other"), "doc_id")

    def strongest(channel: DataFrame, name: str) -> DataFrame:
        near = channel.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= depth)
        v = near.join(votes, "other").withColumn("r", F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= len(THIRDS))
        return v.groupBy("qid", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "sim"))), lambda x: x["sim"]).alias(name))

    freq = labels.groupBy("doc_id").agg(F.count("*").alias("f"))
    top = freq.agg(F.max("f").alias("top"))
    none = F.array().cast("array<double>")
    both = strongest(word, "word").join(strongest(char, "char"), ["qid", "doc_id"], "full").join(freq, "doc_id").crossJoin(F.broadcast(top))  # one row
    part = F.struct("doc_id", F.coalesce("word", none).alias("word"), F.coalesce("char", none).alias("char"), ((F.col("f") + 0.5) / (F.col("top") + 0.5)).alias("prior"))
    parts = both.groupBy("qid").agg(F.collect_list(part).alias("parts"))
    kind = labels.schema["doc_id"].dataType.simpleString()
    rows = _filled(_listed(ranking, gold).join(parts, "qid", "left"), ranking, parts=f"array<struct<doc_id:{kind},word:array<double>,char:array<double>,prior:double>>")
    return swept(rows.select("qid", "base", "gold", "parts", F.col("parts.doc_id").alias("docs")), grid, _kernel_scores)


def _profile_scores(r: dict, at: dict, grid: dict) -> Iterator[np.ndarray]:
    base, parts = base_ranks(r, at), r["parts"]
    slot = np.array([at[x["doc_id"]] for x in parts], np.int64)
    order, tf, idf, length, prior = (np.array([x[c] for x in parts], float) for c in ("words", "tf", "idf", "length", "prior"))
    weight = np.array(PHRASE_WEIGHTS)[order.astype(np.int64) - 1] * idf
    of_doc = np.ones(len(at))
    of_doc[slot] = prior
    for n, k1, b in product(grid["ngram"], grid["k1"], grid["b"]):
        ok = order <= n
        s = np.bincount(slot[ok], (weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length)))[ok], len(at))
        here = np.bincount(slot[ok], minlength=len(at)) > 0
        for pp in grid["prior"]:
            yield blends(ranks_of(np.where(here, s * of_doc**pp, -np.inf)), base, grid["alpha"], grid["k"])


def profile_grid(asked: DataFrame, support: DataFrame, ranking: DataFrame, gold: DataFrame, grid: dict[str, tuple] = PROFILE_GRID) -> DataFrame:
    """Sweep of the profile BM25: asked (qid, feature), support (qid, doc_id, feature); features are ``n:words``, n their number."""
    tf = support.groupBy("doc_id", "feature").agg(F.count("*").alias("tf"))
    dl = tf.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    lf = support.groupBy("doc_id").agg(F.countDistinct("qid").alias("lf"))
    stats = dl.join(lf, "doc_id").agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), F.max("lf").alias("top"))
    df = tf.groupBy("feature").agg(F.count("*").alias("df"))
    held = tf.join(df, "feature").join(asked.select("feature").distinct(), "feature", "left_semi").join(dl, "doc_id").join(lf, "doc_id").crossJoin(F.broadcast(stats))  # one row
    part = F.struct(
        "doc_id", F.substring("feature", 1, 1).cast("int").alias("words"), "tf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
        (F.col("dl") / F.col("mean")).alias("length"), ((F.col("lf") + 0.5) / (F.col("top") + 0.5)).alias("prior"),
    )
    parts = asked.join(held.select("feature", part.alias("part")), "feature").groupBy("qid").agg(F.collect_list("part").alias("parts"))
    kind = support.schema["doc_id"].dataType.simpleString()
    rows = _filled(_listed(ranking, gold).join(parts, "qid", "left"), ranking, parts=f"array<struct<doc_id:{kind},words:int,tf:bigint,idf:double,length:double,prior:double>>")
    return swept(rows.select("qid", "base", "gold", "parts", F.col("parts.doc_id").alias("docs")), grid, _profile_scores)

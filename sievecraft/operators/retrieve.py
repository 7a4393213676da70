"""Top-k retrieval: BM25 over documents, chunks and phrases, question memory, dense vectors, duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators.simjoin import nearest_similar
from sievecraft.session import checkpointed, spread

K1, B = 1.2, 0.75
#: Terms of a query set that are written into the plan.
ASKED_TERMS = 500


def postings(units: DataFrame, terms: Column, unit: str = "doc_id") -> DataFrame:
    """unit, dl, term, tf."""
    t = units.select(unit, terms.alias("w"))
    return t.select(unit, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy(unit, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, units: DataFrame, terms: Column, k: int, unit: str = "doc_id", digits: int = 9) -> DataFrame:
    """qid, unit, score, rank: distinct query terms (qid, term) against units that no index is kept of, such as a small or passing table.

    Each unit's terms are cut to the asked ones before they become rows; where these are more than ``ASKED_TERMS``, rows
    meet them in a join. Document frequencies combine before their shuffle; a non-positive idf is 1e-6.
    """
    asked = queries.select("qid", "term").distinct()
    words = units.select(unit, terms.alias("w")).select(unit, F.size("w").alias("dl"), "w")
    few = [r[0] for r in asked.select("term").distinct().limit(ASKED_TERMS + 1).collect()]
    if len(few) <= ASKED_TERMS:
        every = words.select(unit, "dl", F.explode(F.concat(F.filter("w", lambda x: x.isin(few)), F.array(F.lit("")))).alias("term"))
    else:
        wanted = asked.select("term").distinct().unionByName(units.sparkSession.createDataFrame([("",)], "term string"))
        every = words.select(unit, "dl", F.explode(F.concat("w", F.array(F.lit("")))).alias("term")).join(wanted, "term", "left_semi")
    found = checkpointed(every.groupBy(unit, "dl", "term").agg(F.count("*").alias("tf")))
    stats = found.where("term = ''").agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")).cast("double") / F.sum("tf")).alias("avgdl"))
    found = found.where("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = found.join(df, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = weighed.select(unit, "term", part.alias("part")).join(asked, "term").groupBy("qid", unit).agg(F.round(F.sum("part"), digits).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), unit))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def best_plus_second(chunk_runs: DataFrame, owners: DataFrame | None = None, weight: float = 0.6, chunk: str = "chunk_id") -> DataFrame:
    """qid, doc_id, score: best chunk plus ``weight`` times the second; the limit on chunks came before.

    ``owners`` has the document of each chunk, where the runs do not name it themselves.
    """
    owned = chunk_runs if owners is None else chunk_runs.join(owners, chunk)
    rn = F.row_number().over(W.partitionBy("qid", "doc_id").orderBy(F.desc("score"), chunk))
    return owned.withColumn("rn", rn).where("rn <= 2").groupBy("qid", "doc_id").agg(F.sum(F.when(F.col("rn") == 1, F.col("score")).otherwise(weight * F.col("score"))).alias("score"))


def memory_votes(neighbours: DataFrame, golds: DataFrame, by_score: bool = False) -> DataFrame:
    """qid, doc_id, vote: labelled neighbours vote for their answers by 1/(10 + rank), or their score over it."""
    vote = (F.greatest(F.col("score"), F.lit(0.0)) if by_score else F.lit(1.0)) / (10 + F.col("rank"))
    return neighbours.join(golds.withColumnRenamed("qid", "other"), "other").groupBy("qid", "doc_id").agg(F.sum(vote).alias("vote"))


def dense_best(queries: DataFrame, vectors: DataFrame, k: int, by_owner: bool = False, digits: int = 6, block: int = 20_000) -> DataFrame:
    """qid, vec_id, owner, sim: exact similarity of a stated query set (qid, qvec) to all vectors (vec_id, owner, embedding); whatever can be among the ``k`` best of a query is here.

    A task multiplies ``DENSE_ROWS`` vectors by ``DENSE_QUERIES`` queries at once and hands on the ``k`` best of each
    query, of each owner with ``by_owner``; ties go to the smaller id. Queries are broadcast in blocks of about ``block``.
    A missing vector has no similarity.
    """
    spark = vectors.sparkSession
    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "owner")]
    qkind = queries.schema["qid"].dataType.simpleString()
    shape = f"qid {qkind}, vec_id {kinds[0]}, owner {kinds[1]}, sim double"
    asked = queries.where("qvec is not null")
    held = vectors.where("embedding is not null").select("vec_id", "owner", F.col("embedding").cast("array<double>").alias("embedding"))
    columns = ["qid", "vec_id", "owner", F.lit(None).cast("double").alias("sim")]
    out = vectors.where("embedding is null").crossJoin(queries).select(*columns).unionByName(vectors.where("embedding is not null").crossJoin(queries.where("qvec is null")).select(*columns))
    blocks = max(1, -(-asked.count() // block))
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        rows = some.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).toArrow()  # about ``block`` rows
        shared = spark.sparkContext.broadcast((rows["qid"].combine_chunks(), _matrix(rows["qvec"].combine_chunks())))
        out = out.unionByName(spread(held).mapInArrow(_dense_best(shared, k, by_owner, digits), shape))
    return out


#: Vectors and queries that a task multiplies at once: some 100 MB with what is made of the products.
DENSE_ROWS, DENSE_QUERIES = 32_768, 128


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _dense_best(shared, k: int, by_owner: bool, digits: int):
    def best(held: pa.Table) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        held = held.sort_by([*([("owner", "ascending")] if by_owner else []), ("vec_id", "ascending")]).combine_chunks()
        v, own = _matrix(held["embedding"].combine_chunks()), held["owner"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)] if by_owner else np.array([0, len(own)])
        bits = int(len(own)).bit_length()
        for at in range(0, len(q), DENSE_QUERIES):
            # The last digits of a key are the row's place, so that of equal similarities the smaller id is first.
            key = (-np.rint((q[at : at + DENSE_QUERIES] @ v.T + 1e-10) * 10**digits).astype(np.int64) << bits) | np.arange(len(own))
            found = [np.partition(key[:, a:b], k - 1, axis=1)[:, :k] if b - a > k else key[:, a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            key = np.concatenate(found, axis=1)
            row, of = (key & ((1 << bits) - 1)).ravel(), np.repeat(np.arange(at, at + len(key)), key.shape[1])
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(of)), *[held[c].combine_chunks().take(pa.array(row)) for c in ("vec_id", "owner")], pa.array(-(key >> bits).ravel() / 10**digits)], names=["qid", "vec_id", "owner", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for b in batches:
            some, n = [*some, b], n + b.num_rows
            if n >= DENSE_ROWS:
                yield from best(pa.Table.from_batches(some))
                some, n = [], 0
        if n:
            yield from best(pa.Table.from_batches(some))

    return run


def top_k(runs: DataFrame, key: str, by: str, tie: str, k: int) -> DataFrame:
    return runs.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(by), tie))).where(F.col("rank") <= k)


def top2_mean(pairs: DataFrame) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("qid", "owner").orderBy(F.desc("sim"), "vec_id"))
    return pairs.withColumn("rn", rn).where("rn <= 2").groupBy("qid", "owner").agg(F.avg("sim").alias("score"))


def vocabulary(p: DataFrame, units: int, least_df: int = 1, most_share: float = 1.0, most_terms: int | None = None) -> DataFrame:
    """term, df of the terms of postings ``p`` that stay.

    A term stays if ``least_df`` units hold it at least and a share ``most_share`` of them at most; of these the
    ``most_terms`` that occur most often, ties to the smaller term.
    """
    kept = p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where((F.col("df") >= least_df) & (F.col("df") <= most_share * units))
    return (kept if most_terms is None else kept.orderBy(F.desc("cf"), "term").limit(most_terms)).select("term", "df")


def tfidf_weights(units: DataFrame, features: Column, unit: str, least_df: int = 1, most_share: float = 1.0, most_terms: int | None = None) -> DataFrame:
    """unit, term, weight: (1 + ln tf)(ln((1 + N)/(1 + df)) + 1) over the vocabulary that stays, rows of unit length."""
    p = postings(units, features, unit)
    n = units.count()
    raw = p.join(vocabulary(p, n, least_df, most_share, most_terms), "term").withColumn("x", (1 + F.log("tf")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(unit)))).select(unit, "term", "weight")


def masked_kernel(a: DataFrame, blocks: DataFrame, depth: int = 400, digits: int = 9) -> DataFrame:
    """qid, other, sim, rank: the ``depth`` nearest questions of other blocks (qid, block) than a question's own."""
    with_block = a.join(blocks, "qid")
    other = with_block.select(F.col("qid").alias("other"), "term", F.col("weight").alias("w2"), F.col("block").alias("b2"))
    met = with_block.join(other, "term").where("block <> b2").groupBy("qid", "other").agg(F.round(F.sum(F.col("weight") * F.col("w2")), digits).alias("sim"))
    return top_k(met, "qid", "sim", "other", depth)


def kernel(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """qid, other, sim: cosine over shared terms."""
    return a.join(b.select(F.col("qid").alias("other"), "term", F.col("weight").alias("w2")), "term").where("qid <> other").groupBy("qid", "other").agg(F.round(F.sum(F.col("weight") * F.col("w2")), digits).alias("sim"))


def near_questions(units: DataFrame, folds: DataFrame, grams: Column, least: float = 0.92, k: int = 5) -> DataFrame:
    """a, b, sim: pairs of questions of different folds, at least ``least`` alike, one among the ``k`` nearest of the other.

    Cosine of TF-IDF over ``grams`` that two questions hold at least, by an exact join on rare terms.
    """
    near = nearest_similar(checkpointed(tfidf_weights(units, grams, "qid", 2)), least, k)
    j = near.join(folds.withColumnRenamed("fold", "fa"), "qid").join(folds.select(F.col("qid").alias("other"), F.col("fold").alias("fb")), "other").where("fa <> fb")
    return j.groupBy(F.least("qid", "other").alias("a"), F.greatest("qid", "other").alias("b")).agg(F.max("sim").alias("sim"))

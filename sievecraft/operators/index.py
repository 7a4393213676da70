"""A stored inverted index that all lexical queries of a table share, at document and at chunk grain.

A row of the postings is a term in a document: the document's length, how often the term occurs, and the same for each
chunk of the document that has it. Documents are dealt into segments of bounded size, postings are partitioned by
segment and bucketed and sorted by term within it, so the longest postings list of a file grows with a segment, not
with the corpus. With the postings stand the number of documents and chunks of each term, and one row of totals per
segment, which is written last and marks the index as whole. A term is a word, or ``width`` words in a row.

An index belongs to a signature of its table (see ``readers.signature_of``): it is read again as long as that
fits, and built anew if not. ``append`` adds documents as new segments; totals and document frequencies are sums over
segments, so nothing that is stored is written again.

Queries read the postings of the asked terms only. What is broadcast is checked: ``ASKED_ROWS`` rows of asked terms at
most; with these, postings are dealt by document, and a task scores its documents for all queries and hands on the best
alone. Larger sets meet the postings by a join in which the terms that hold most are dealt over several keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.session import arrow_batches, checkpointed, shared_folder, spread
from sievecraft.sources.readers import signature_of as signature

K1, B = 1.2, 0.75
SIZE, STEP = 500, 400  # tokens of a chunk, and from one chunk's start to the next
#: Characters of text in a segment, least buckets of a segment, rows of asked terms that are broadcast, literal terms of a scan.
SEGMENT_CHARS, BUCKETS, ASKED_ROWS, FEW_TERMS = 4_000_000_000, 8, 300_000, 256
#: A term is dealt over several keys if it holds more than this share of all documents, so there are few such terms.
HOT_SHARE = 0.001
#: Postings that a task scores at once, some 70 bytes each.
TASK_POSTINGS = 3_000_000
#: Characters of text in a bucket of single words; a task writes one bucket (by hash, some had several and others none).
BUCKET_CHARS = 64_000_000
#: Goes up when what is stored changes, so that older indexes are left alone.
FORMAT = 3
TOTALS = ("docs", "doc_terms", "chunks", "chunk_terms")


def last_chunk(tokens: np.ndarray) -> np.ndarray:
    """Number of the last chunk of a document: chunks stop once one reaches the end."""
    return np.maximum(tokens - (SIZE - STEP) - 1, 0) // STEP


def counted(row: np.ndarray, at: np.ndarray, term: np.ndarray, kinds: int, n: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """row, term, tf of each term (of ``kinds``) in each document of ``n`` tokens, by the places where terms start; which of these, chunk, tf in documents of several chunks."""
    key, which, tf = np.unique(row * kinds + term, return_inverse=True, return_counts=True)
    last = last_chunk(n)
    high = np.minimum(at // STEP, last[row])
    low = np.maximum((at + width - 1 - (SIZE - STEP)) // STEP, 0)
    both = low < high
    chunk, of = np.concatenate((high, low[both])), np.concatenate((which, which[both]))
    span = int(chunk.max(initial=0)) + 1
    ckey, ctf = np.unique(of * span + chunk, return_counts=True)
    of, chunk = ckey // span, ckey % span
    found = key // kinds
    several = last[found[of]] > 0
    return found, key % kinds, tf, of[several], chunk[several], ctf[several]


def postings_of(ids: pa.Array, tokens: pa.ListArray, width: int) -> pa.RecordBatch:
    """term, doc_id, tokens, tf, chunks of some documents; the empty term stands once for each document.

    Documents of one chunk, which most are, have null in place of the chunk that says the same as the row.
    """
    offsets = tokens.offsets.to_numpy().astype(np.int64)
    flat, offsets = tokens.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - offsets[row]
    terms = flat
    if width > 1:
        whole = len(flat) - width + 1
        terms = pc.binary_join_element_wise(*[flat.slice(k, max(whole, 0)) for k in range(width)], " ")
        row, at = row[: max(whole, 0)], at[: max(whole, 0)]
        within = at <= n[row] - width
        terms, row, at = terms.filter(pa.array(within)), row[within], at[within]
    words = terms.dictionary_encode()
    kinds = max(len(words.dictionary), 1)
    found, term, tf, of, chunk, ctf = counted(row, at, words.indices.to_numpy(zero_copy_only=False), kinds, n, width)
    several = last_chunk(n)[found] > 0
    held = pa.StructArray.from_arrays([pa.array(chunk.astype(np.int32)), pa.array(ctf.astype(np.int32))], names=["no", "tf"])
    bounds = np.searchsorted(of, np.arange(len(found) + 1))
    some = len(n)  # one row with the empty term per document
    columns = [
        pa.concat_arrays([words.dictionary.take(pa.array(term)).cast(pa.string()), pa.array([""] * some, pa.string())]),
        pa.concat_arrays([ids.take(pa.array(found)), ids]),
        pa.array(np.concatenate((n[found], n)).astype(np.int64)),
        pa.array(np.concatenate((tf, np.ones(some, np.int64))).astype(np.int64)),
        pa.ListArray.from_arrays(pa.array(np.concatenate((bounds, np.full(some, bounds[-1]))).astype(np.int32), mask=np.concatenate((~several, np.ones(some, bool), [False]))), held),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "doc_id", "tokens", "tf", "chunks"])


def _postings(docs: DataFrame, width: int, segments: int, first: int, buckets: int, rows: int = 512) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                some = b.slice(at, rows)
                yield postings_of(some.column(0), some.column(1), width)

    words = docs.select("doc_id", X.tokens(F.col("text")).alias("words")).where("doc_id is not null")
    found = words.mapInArrow(run, f"term string, doc_id {kind}, tokens long, tf long, chunks array<struct<no:int,tf:int>>")
    segment = (F.pmod(F.xxhash64("doc_id"), F.lit(segments)) + first).cast("int")
    return found.withColumn("segment", segment).withColumn("bucket", bucket_of(buckets))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    """An opened index: its folder, words of a term, buckets, segments, and its TOTALS over these."""

    spark: SparkSession
    folder: str
    kind: str  # type of doc_id
    width: int
    buckets: int
    segments: int
    totals: dict[str, int]

    @property
    def postings(self) -> DataFrame:
        """segment, bucket, term, doc_id, tokens, tf, chunks, without what an unfinished append may have left."""
        return _stored_postings(self.spark, self.folder, self.kind).where(F.col("segment") < self.segments)

    @property
    def terms(self) -> DataFrame:
        """first, bucket, term, docs, chunks of each append."""
        return self.spark.read.schema("term string, docs long, chunks long, first int, bucket int").parquet(f"{self.folder}/terms").where(F.col("first") < self.segments)


def _stored_postings(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(f"term string, doc_id {kind}, tokens long, tf long, chunks array<struct<no:int,tf:int>>, segment int, bucket int").parquet(f"{folder}/postings")


def open_index(spark: SparkSession, folder: str) -> LexicalIndex | None:
    """The index in ``folder``; None if none was finished there."""
    try:
        rows = spark.read.parquet(f"{folder}/totals").collect()  # one row per append
    except AnalysisException:
        return None
    return LexicalIndex(spark, folder, rows[0]["kind"], rows[0]["width"], rows[0]["buckets"], max(r["first"] + r["segments"] for r in rows), {k: sum(r[k] or 0 for r in rows) for k in TOTALS})


def _write(docs: DataFrame, folder: str, width: int, first: int, buckets: int | None, segment_chars: int) -> LexicalIndex:
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.char_length("text"))).head()[0] or 0
    segments = max(1, -(-chars // segment_chars))
    # Runs of words are more different ones than words, and each is as long as all of its words.
    buckets = buckets or int(min(8 * BUCKETS * width**2, max(BUCKETS, chars * width**2 // (segments * BUCKET_CHARS))))
    found = _postings(spread(docs), width, segments, first, buckets)
    # Segments are overwritten alone, so an append that was cut short is simply done again.
    put = lambda df, name, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{folder}/{name}")
    with arrow_batches(spark, 1024):
        put(found.repartitionById(int(min(segments * buckets, 100_000)), (F.col("segment") - first) * buckets + F.col("bucket")).sortWithinPartitions("segment", "bucket", "term"), "postings", "segment", "bucket")
    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = _stored_postings(spark, folder, kind).where(F.col("segment").between(first, first + segments - 1))
    df = mine.where("term <> ''").groupBy("bucket", "term").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("chunks").isNull(), 1).otherwise(F.size("chunks"))).cast("long").alias("chunks"))
    put(df.select("term", "docs", "chunks", F.lit(first).alias("first"), "bucket").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "term"), "terms", "first", "bucket")
    last = F.expr(f"greatest(tokens - {SIZE - STEP} - 1, 0) div {STEP}")
    inner = F.greatest(F.col("tokens") - (width - 1), F.lit(0))
    # The first chunks are full, so a document's chunks hold its tokens and what they share.
    chunk_terms = F.when(last == 0, inner).otherwise(F.col("tokens") + (SIZE - STEP) * last - (width - 1) * (last + 1))
    sums = mine.where("term = ''").agg(F.count("*").alias("docs"), F.sum(inner).alias("doc_terms"), F.sum(last + 1).alias("chunks"), F.sum(chunk_terms).alias("chunk_terms"))
    sums.select(F.lit(first).alias("first"), F.lit(segments).cast("int").alias("segments"), F.lit(kind).alias("kind"), F.lit(width).alias("width"), F.lit(buckets).alias("buckets"), *TOTALS).coalesce(1).write.mode("append").parquet(f"{folder}/totals")
    return open_index(spark, folder)


def build(docs: DataFrame, folder: str, width: int = 1, segment_chars: int = SEGMENT_CHARS) -> LexicalIndex:
    """Index all documents (doc_id, text) that have an id; ``folder`` must not hold an index already."""
    if open_index(docs.sparkSession, folder) is not None:
        raise ValueError(f"{folder} holds an index; append to it, or take another folder")
    return _write(docs.select("doc_id", "text"), folder, width, 0, None, segment_chars)


def append(index: LexicalIndex, docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> LexicalIndex:
    """The index with the documents among ``docs`` that it does not hold yet, in segments of their own."""
    held = index.postings.where(F.col("term") == "").select("doc_id")
    return _write(docs.select("doc_id", "text").join(held, "doc_id", "left_anti"), index.folder, index.width, index.segments, index.buckets, segment_chars)


def stored(docs: DataFrame, width: int = 1) -> LexicalIndex:
    """The index of ``docs`` (doc_id, text) in the shared folder: opened if its signature fits, else built."""
    spark = docs.sparkSession
    name = hashlib.sha256(f"{FORMAT} {signature(docs)} {docs.schema['doc_id'].dataType.simpleString()} {width} {SIZE} {STEP}".encode()).hexdigest()[:24]
    folder = f"{shared_folder(spark)}/sievecraft-index/{name}"
    return open_index(spark, folder) or build(docs, folder, width)


def _weighed(index: LexicalIndex, asked: DataFrame, grain: str) -> DataFrame:
    """qid, bucket, term, df, units, idf of the asked terms (qid, term) that the index has: its documents, its units of that grain."""
    want = asked.select("qid", "term").where("term <> ''").distinct().withColumn("bucket", bucket_of(index.buckets))
    n = index.totals["docs" if grain == "doc" else "chunks"]
    df = index.terms.join(want.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("docs").alias("docs"), F.sum("chunks").alias("chunks"))
    f = F.col("docs" if grain == "doc" else "chunks")
    idf = F.log((n - f + 0.5) / (f + 0.5))
    return checkpointed(want.join(df, ["bucket", "term"]).select("qid", "bucket", "term", F.col("docs").alias("df"), f.alias("units"), F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf")))


def _postings_of(index: LexicalIndex, weighed: DataFrame, grain: str) -> DataFrame:
    postings = index.postings.where("term <> ''").select("bucket", "term", "doc_id", "tokens", "tf", *(["chunks"] if grain == "chunk" else []))
    few = [(r["bucket"], r["term"]) for r in weighed.select("bucket", "term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:  # literals prune buckets and row groups
        postings = postings.where(F.col("bucket").isin(sorted({b for b, _ in few})) & F.col("term").isin([t for _, t in few]))
    return postings


def _of_grain(hits: DataFrame, grain: str, *columns: str) -> DataFrame:
    """``columns``, doc_id, tokens, tf of each hit; at chunk grain no and tf of each of its chunks."""
    if grain == "doc":
        return hits.select(*columns, "doc_id", "tokens", "tf")
    alone = F.array(F.struct(F.lit(0).alias("no"), F.col("tf").cast("int").alias("tf")))
    return hits.select(*columns, "doc_id", "tokens", F.inline(F.coalesce("chunks", alone)))


def _joined(index: LexicalIndex, weighed: DataFrame, grain: str, mean: float, digits: int) -> DataFrame:
    """qid, unit, score of all hits, for more asked terms than are broadcast: they meet the postings by a join."""
    # Hot terms number 1 / HOT_SHARE times the different terms of a document at most, whatever the corpus; each is dealt over keys of one size.
    limit = max(1, int(HOT_SHARE * index.totals["docs"]))
    hot = weighed.where(F.col("df") > limit).select("bucket", "term", F.ceil(F.col("df") / limit).cast("int").alias("keys")).distinct()
    dealt = _postings_of(index, weighed, grain).join(F.broadcast(hot), ["bucket", "term"], "left").withColumn("key", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("keys")).cast("int"), F.lit(0))).drop("keys")
    spread = weighed.withColumn("key", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("df") / limit).cast("int"), F.lit(1)) - 1)))
    hits = _of_grain(dealt.join(spread, ["bucket", "term", "key"]), grain, "qid", "idf")
    size = F.col("tokens") if grain == "doc" else F.least(F.lit(SIZE), F.col("tokens") - STEP * F.col("no"))
    size = F.greatest(size - (index.width - 1), F.lit(0))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * size / mean))
    unit = ["doc_id"] if grain == "doc" else ["doc_id", "no"]
    return hits.select("qid", *unit, part.alias("part")).groupBy("qid", *unit).agg(F.round(F.sum("part"), digits).alias("score"))


def best_units(asked: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray], postings: pa.Table, k: int, mean: float, width: int, digits: int, floors: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """qid, doc_id, no if it is given, score of the ``k`` best units of each query among these, whose postings (t, doc_id, tokens, tf) are whole.

    ``asked`` has the queries' ids, where the terms of each start, the numbers of these terms and their idf.
    Units below a query's floor are left out.
    """
    qids, starts, terms, idf = asked
    grain = ["no"] if "no" in postings.column_names else []
    t, tf, size = (postings[c].to_numpy() for c in ("t", "tf", "tokens"))
    ids = postings["doc_id"].combine_chunks().dictionary_encode()
    sorting = pc.sort_indices(ids.dictionary).to_numpy()
    names, place = ids.dictionary.take(pa.array(sorting)), np.argsort(sorting)
    unit = place[ids.indices.to_numpy()]  # in order of the ids, which settles ties
    span = 1
    if grain:
        no = postings["no"].to_numpy().astype(np.int64)
        size, span = np.minimum(SIZE, size - STEP * no), int(no.max()) + 1
        unit = unit * span + no
    units, unit = np.unique(unit, return_inverse=True)
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(size - (width - 1), 0) / mean))
    order = np.argsort(t, kind="stable")
    first = np.searchsorted(t[order], np.arange(int(terms.max(initial=-1)) + 2))
    unit, part = unit[order], part[order]
    for q in range(len(qids)):
        at, weight = terms[starts[q] : starts[q + 1]], idf[starts[q] : starts[q + 1]]
        count = first[at + 1] - first[at]
        rows = np.repeat(first[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        total = np.bincount(unit[rows], np.repeat(weight, count) * part[rows], len(units))
        found = np.flatnonzero(total > 0)  # idf and parts are above 0, so these are all that hold a term
        score = np.floor(total[found] * 10**digits + 0.5) / 10**digits
        if floors is not None:
            found, score = found[score >= floors[q]], score[score >= floors[q]]
        if len(found) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[score >= least], score[score >= least]
        best = np.lexsort((found, -score))[:k]
        at = units[found[best]]
        columns = [qids.take(pa.array(np.full(len(at), q))), names.take(pa.array(at // span)), *([pa.array((at % span).astype(np.int32))] if grain else []), pa.array(score[best])]
        yield pa.RecordBatch.from_arrays(columns, names=["qid", "doc_id", *grain, "score"])


def _best_of_tasks(index: LexicalIndex, weighed: DataFrame, k: int, grain: str, mean: float, digits: int) -> DataFrame:
    """qid, unit, score: the ``k`` best of each task, which has some documents whole; hits never become rows.

    Postings of the asked terms move once, by document, into tasks of about ``TASK_POSTINGS``, however many queries ask.
    """
    spark = index.spark
    rows = weighed.toArrow()  # ASKED_ROWS at most
    term = rows["term"].combine_chunks().dictionary_encode()
    qid = rows["qid"].combine_chunks().dictionary_encode()
    number, query = term.indices.to_numpy(), qid.indices.to_numpy()
    order = np.lexsort((number, query))
    starts = np.searchsorted(query[order], np.arange(len(qid.dictionary) + 1))
    shared = spark.sparkContext.broadcast((qid.dictionary, starts, number[order].astype(np.int64), rows["idf"].to_numpy()[order]))
    one = np.unique(number, return_index=True)[1]
    named = pa.table({"bucket": rows["bucket"].take(pa.array(one)), "term": rows["term"].take(pa.array(one)), "t": pa.array(number[one].astype(np.int32))})
    held = int(rows["units"].to_numpy()[one].sum()) if len(one) else 0
    parts = max(1, -(-held // TASK_POSTINGS), min(spark.sparkContext.defaultParallelism, held // 100_000))
    small = [F.col("tokens").cast("int").alias("tokens"), F.col("tf").cast("int").alias("tf"), *(["chunks"] if grain == "chunk" else [])]
    found = _postings_of(index, weighed, grain).join(F.broadcast(spark.createDataFrame(named, "bucket int, term string, t int")), ["bucket", "term"]).select("t", "doc_id", *small)
    kind = weighed.schema["qid"].dataType.simpleString()
    width, numbered = index.width, "no int, " if grain == "chunk" else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            yield from best_units(shared.value, pa.Table.from_batches(some), k, mean, width, digits)

    return _of_grain(found.repartition(parts, "doc_id"), grain, "t").mapInArrow(run, f"qid {kind}, doc_id {index.kind}, {numbered}score double")


def bm25(index: LexicalIndex, asked: DataFrame, k: int, grain: str = "doc", digits: int = 9) -> DataFrame:
    """qid, doc_id, score, rank of the ``k`` best documents of each query (qid, term); with ``grain`` chunk also no, the chunk's number.

    A term counts once for a query; an idf that is not positive is 1e-6. Ties go to the smaller id, then chunk.
    """
    unit = ["doc_id"] if grain == "doc" else ["doc_id", "no"]
    units, total = (index.totals["docs"], index.totals["doc_terms"]) if grain == "doc" else (index.totals["chunks"], index.totals["chunk_terms"])
    mean = max(total / max(units, 1), 1e-9)
    weighed = _weighed(index, asked, grain)
    scores = _best_of_tasks(index, weighed, k, grain, mean, digits) if weighed.count() <= ASKED_ROWS else _joined(index, weighed, grain, mean, digits)
    return scores.select("qid", *unit, "score").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), *unit))).where(F.col("rank") <= k)

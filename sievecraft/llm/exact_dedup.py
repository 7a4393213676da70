"""Exact deduplication by content-defined chunk recipes. DataFrame functions only.

Each text is normalised (white space of ``[\\x20\\x09-\\x0D]`` deleted) and cut into chunks whose ends depend on
content: the first sentence end after ``min_chunk`` characters, or where there is none within ``max_chunk``, the first
place between two letters or digits of set kinds (about one place in twenty); a text without either, such as a run of
one letter, is cut at ``max_chunk``. After an insertion cuts fall together again at the next shared end. A chunk's identifier is its
64-bit hash, *verified*: the chunk contents are deduplicated once, and wherever two contents share a hash each gets an
ordinal besides it. A text is then its recipe, the ordered list of identifiers, and equal recipes are equal texts. Only
recipes (about 1 % of the text) and row keys move afterwards; the text itself moves once, as distinct chunks. Texts are
read twice, for the chunks and for the recipes, which are written; the few recipes that hold a large share of the rows
are joined by a broadcast of bounded size.

Defined results: a null text counts as empty and all empty texts are one group; ties go to the smallest id, null ids
last; a row repeated in full counts in ``group_size`` and shares the mark of its twin; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.hot import join_per_key
from sievecraft.session import checkpointed

WHITE = r"[\x20\x09-\x0D]+"
#: Sentence ends of common scripts close a chunk.
CHUNK_END = r"[.!?;:\u3002\uFF01\uFF1F\u2026\u0964\u061F]"
#: Two neighbours between which a chunk may end where there is no sentence end.
NEIGHBOURS = r"[aeiou0-4AEIOU\u0400-\u0418\u0430-\u0438\u4E00-\u62FF](?=[b-h5-9B-H\u0419-\u042F\u0439-\u044F\u6300-\u77FF])"


def content_chunks(norm: Column, min_chunk: int = 512, max_chunk: int = 4096) -> Column:
    """Cut a text after the first sentence end past ``min_chunk`` characters; without one, between NEIGHBOURS, or at ``max_chunk``."""
    reach = f"(?s).{{{min_chunk - 1},{max_chunk - 1}}}?"
    pattern = f"{reach}{CHUNK_END}|{reach}{NEIGHBOURS}|(?s).{{1,{max_chunk}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, n_cp, text_sha256, chunks, recipe of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_cp"), F.regexp_replace(text, WHITE, "").alias("norm"))
        .select("doc_id", "n_cp", F.sha2("norm", 256).alias("text_sha256"), content_chunks(F.col("norm")).alias("chunks"))
        .withColumn("recipe", F.transform("chunks", lambda c: chunk_hash(c)))
    )


def ambiguous_chunks(parts: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Chunk contents that share their hash with another content: h, chunk, ordinal (1 for the second and so on).

    Contents are deduplicated map-side before they move, so a passage of very many documents moves once a task.
    """
    contents = parts.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    verified = checkpointed(contents.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1"))
    if verified.isEmpty():
        return contents.where(F.lit(False)).select("h", "chunk", F.lit(1).alias("ordinal"))
    # The contents of one hash are a handful, so the list per hash is small.
    listed = contents.join(verified, "h", "left_semi").groupBy("h").agg(F.array_sort(F.collect_list("chunk")).alias("all"))
    return checkpointed(listed.select("h", F.posexplode("all").alias("ordinal", "chunk")).where("ordinal > 0").select("h", "chunk", "ordinal"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the most code points in its original text stays, then the smallest doc_id.
    ``chunk_hash`` is for tests: a weak hash must give the same result.
    """
    parts = chunked(docs, id_col, text_col, chunk_hash)
    twins = ambiguous_chunks(parts, chunk_hash)
    rows = parts.select("doc_id", "n_cp", "text_sha256", "recipe", F.size("chunks").cast("long").alias("n_chunks"))
    key = ["recipe"]
    if not twins.isEmpty():
        places = parts.select("text_sha256", F.posexplode("chunks").alias("at", "chunk")).select("text_sha256", "at", "chunk", chunk_hash(F.col("chunk")).alias("h"))
        marks = places.join(twins, ["h", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_set(F.struct("at", "ordinal"))).alias("marks"))
        rows = rows.join(marks, "text_sha256", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<at:int,ordinal:int>>")))
        key = ["recipe", "marks"]
    best = F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best")
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy(*key).agg(best, F.count("*").alias("group_size")).where("group_size > 1"))
    joined = join_per_key(rows, groups, key, "group_size", rows.count(), "left")
    keep = F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    same = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("best.less") == -F.col("n_cp")))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), same.alias("kept"), "text_sha256", "n_chunks")

"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm import bpe, langid, line_dedup, mixing, queries, simhash
from sievecraft.session import checkpointed, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go; so do texts without a letter (null and empty ones too)."""
    models = langid.fit_language_models(docs)
    return langid.identify_languages(docs, models).where(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document that has them."""
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_per_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: a row per document and epoch, its text being the words taken, in schedule order.

    Texts without a word have nothing to take and go.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    ranks = bpe.read_ranks(queries.public_tokenizers.path(queries.VOCABULARY))
    return bpe.encode_decode(docs, ranks, queries.public_tokenizers.PATTERN)


STAGES = [("language", language), ("line dedup", lines), ("near duplicates", near_duplicates), ("mixing", mixture), ("bpe", tokens)]
#: Language models, components and byte pair merges are no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs

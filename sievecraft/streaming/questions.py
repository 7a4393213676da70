"""Optional extension: a stream of questions answered against a static index, one BM25 run per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions import text as X
from sievecraft.operators import retrieve


def answer_stream(spark: SparkSession, folder: str, docs: DataFrame, out: str, checkpoint: str, k: int = 10):
    """Read JSON lines (qid, question) as they arrive and append the ranked answers as parquet; ends when all is read."""
    asked = spark.readStream.schema("qid long, question string").json(folder)

    def answer(batch: DataFrame, _: int) -> None:
        terms = batch.select("qid", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("term"))
        retrieve.bm25(terms, docs, X.tokens(F.col("text")), k).write.mode("append").parquet(out)

    return asked.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Sinks: answer JSON in a ZIP, canonical JSON lines with a digest, incremental appends, latest-wins tables."""

from __future__ import annotations

import hashlib
import json
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.session import checkpointed


def answer_zip(answers: DataFrame, path: str, member: str = "answers.json", most: int = 100_000) -> str:
    """{qid: {"answer": [ids]}} as the single member of a ZIP; returns its SHA-256. One file of at most ``most`` queries."""
    rows = answers.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("a")).orderBy("qid").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many queries for one answer file")
    body = json.dumps({str(r["qid"]): {"answer": [str(x["doc_id"]) for x in r["a"]]} for r in rows}, ensure_ascii=False, sort_keys=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(member), body)
    return hashlib.sha256(body.encode()).hexdigest()


def canonical_lines(df: DataFrame, key: str) -> DataFrame:
    """One JSON line per row with sorted columns, and its digest."""
    line = F.to_json(F.struct(*sorted(df.columns)))
    return df.select(key, line.alias("line")).withColumn("digest", F.sha2("line", 256))


def missing(todo: DataFrame, done: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """What a run with this configuration has yet to compute."""
    return todo.join(done.where(F.col("config_hash") == fingerprint).select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def written_once(df: DataFrame, path: str, key: str) -> str:
    """Write canonical lines and their digest's sidecar; an equal output is left alone, an unequal one raises.

    Spark's committer moves the parts into place when all of them are written, so no reader sees half an output. The
    digest is a sum over the rows' digests and so does not depend on their order.
    """
    lines = canonical_lines(df, key).persist()
    total = str(lines.agg(F.count("*"), F.sum(F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(38,0)"))).first()[:])
    mark = hashlib.sha256(total.encode()).hexdigest()
    spark = df.sparkSession
    try:
        old = spark.read.text(f"{path}.sha256").first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None and old != mark:
        raise ValueError(f"{path} holds something else")
    if old is None:
        lines.orderBy(key).select("line").write.mode("errorifexists").text(path)
        spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{path}.sha256")
    lines.unpersist()
    return mark


def upserted(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``df`` holds rows of; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upserted_rows(df: DataFrame, path: str, keys: list[str], partition: str, progress: DataFrame | None = None) -> None:
    """Put rows in, or in place of those with the same ``keys``, which hold ``partition``; then append a row of ``progress``.

    Only the partitions that ``df`` has rows of are read and written again. Rows must not repeat a key. Progress
    (``path``_progress) is written last, so a run that is cut short has none and is done again.
    """
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows repeat a key of {', '.join(keys)}")
    try:
        old = df.sparkSession.read.schema(df.schema).parquet(path)
        touched = df.select(partition).distinct()
        df = old.join(touched, partition, "left_semi").join(df.select(*keys), keys, "left_anti").unionByName(df)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    upserted(checkpointed(df), path, partition)
    if progress is not None:
        progress.write.mode("append").parquet(f"{path}_progress")


def appended(df: DataFrame, path: str, fingerprint: str) -> None:
    """Append rows under a configuration's fingerprint; raises if the table was written under another one."""
    spark = df.sparkSession
    try:
        others = spark.read.parquet(path).where(F.col("config_hash") != fingerprint).limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        others = 0
    if others:
        raise ValueError(f"{path} was written under another configuration")
    df.withColumn("config_hash", F.lit(fingerprint)).write.mode("append").parquet(path)


def vectors_appended(texts: DataFrame, path: str, key: str, text: str, encode, dim: int, at_once: int = 512, least: int = 8) -> None:
    """Append (key, embedding) of texts that ``path`` lacks, ``at_once`` texts to a call of ``encode``.

    ``encode`` maps a list of texts to a matrix of ``dim`` columns. Where it raises MemoryError the number of texts is
    halved, down to ``least``, and tried again; other errors end the task. A null text counts as empty.
    """
    import numpy as np
    import pandas as pd

    spark = texts.sparkSession
    try:
        todo = texts.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = texts

    def encoded(some: list[str]):
        at, size, out = 0, at_once, []
        while at < len(some):
            try:
                out.append(np.asarray(encode(some[at : at + size]), dtype=np.float32).reshape(-1, dim))
                at += size
            except MemoryError:
                if size <= least:
                    raise
                size = max(least, size // 2)
        return list(np.concatenate(out)) if out else []

    def part(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "embedding": encoded([x if isinstance(x, str) else "" for x in b[text]])})

    kind = texts.schema[key].dataType.simpleString()
    todo.select(key, text).mapInPandas(part, f"`{key}` {kind}, embedding array<float>").write.mode("append").parquet(path)

"""Sources: document and question JSON, JSON lines, chunk files, payload tables, vectors, file signatures."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.functions import text as X


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, link of one JSON object per file; an empty passage is replaced by the title in the link."""
    raw = spark.read.schema("id string, passage string, link string").option("multiLine", True).json(path)
    return raw.select(F.col("id").alias("doc_id"), F.coalesce(F.nullif(F.trim("passage"), F.lit("")), X.title_from_link(F.col("link")), F.lit("")).alias("text"), "link")


def document_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids from file names alone."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"_([^_/]+)\.json$", 1).alias("doc_id"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, gold of a JSON object keyed by qid; bare strings are questions, order is kept in q_ord."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "map<string,string>")).alias("q_ord", "qid", "v"))
    s = F.from_json("v", "struct<question string, answer array<string>>")
    return raw.withColumn("s", s).select("q_ord", "qid", F.coalesce("s.question", "v").alias("question"), F.col("s.answer").alias("gold"))


def labelled(q: DataFrame) -> DataFrame:
    return q.where(F.size("gold") > 0)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line; blank lines are skipped, a line that is no JSON raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def channels(spark: SparkSession, path: str, branch: str) -> DataFrame:
    """qid, branch, doc_id, score of a JSON file {qid: {doc_id: score}}, bare or below the key "scores"."""
    raw = spark.read.text(path, wholetext=True)
    inner = F.from_json(F.get_json_object("value", "$.scores"), "map<string,map<string,double>>")
    each = raw.select(F.explode(F.coalesce(inner, F.from_json("value", "map<string,map<string,double>>"))).alias("qid", "of"))
    return each.select("qid", F.lit(branch).alias("branch"), F.explode("of").alias("doc_id", "score"))


def npy_rows(spark: SparkSession, path: str, rows_at_once: int = 4096) -> DataFrame:
    """row, embedding of a .npy matrix in a folder that driver and executors share; tasks map their rows into memory."""
    import numpy as np
    import pandas as pd

    n = np.load(path, mmap_mode="r").shape[0]

    def part(batches):
        m = np.load(path, mmap_mode="r")
        for b in batches:
            for at in b["id"]:
                some = np.asarray(m[at : at + rows_at_once], dtype=np.float32)
                yield pd.DataFrame({"row": np.arange(at, at + len(some)), "embedding": list(some)})

    return spark.range(0, n, rows_at_once).mapInPandas(part, "row long, embedding array<float>")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("id string, chunk map<string,string>").json(path)
    return raw.select(F.col("id").alias("doc_id"), F.explode("chunk").alias("chunk_id", "text")).where(F.trim("text") != "")


def payload_runs(rows: DataFrame) -> DataFrame:
    """Ranked lists out of a JSON payload column."""
    p = F.from_json("payload", "array<struct<doc_id string, rank int, score double>>")
    return rows.select("q", "source", F.inline(p))


def checked_runs(rows: DataFrame) -> DataFrame:
    """As payload_runs, of payloads that are whole: raises if one is no list, names a document twice, or its ranks do not count from 1."""
    p = F.from_json("payload", "array<struct<doc_id string, rank int, score double>>")
    ranks, names = F.array_sort(F.transform(p, lambda x: x["rank"])), F.transform(p, lambda x: x["doc_id"])
    counted = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p))).otherwise(F.array().cast("array<int>"))
    whole = p.isNotNull() & (ranks == counted) & (F.size(F.array_distinct(names)) == F.size(p)) & ~F.exists(names, lambda x: x.isNull())
    bad = rows.where(~F.coalesce(whole, F.lit(False))).select("q", "source").limit(5).collect()
    if bad:
        raise ValueError(f"broken payloads, such as {[tuple(r) for r in bad]}")
    return payload_runs(rows)


def signature(spark: SparkSession, path: str) -> DataFrame:
    """files, bytes of a folder, without reading contents."""
    return spark.read.format("binaryFile").load(path).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def signature_of(df: DataFrame) -> str:
    """A short name of a table's state: number, sizes, times and paths of the files it is read from, whose contents stay unread.

    A table that is not read from files is named by its rows.
    """
    try:
        each = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        size = F.sum("file_size")
    except AnalysisException:
        each, size = df, F.count("*")
    r = each.agg(F.count("*"), size, F.expr(f"bit_xor(xxhash64({', '.join(f'`{c}`' for c in each.columns)}))")).head()
    return " ".join(map(str, r))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name (the path below the folder), h (SHA-256) of every file of a folder and its subfolders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.split(":", 1)[-1].lstrip("/").rstrip("/")
    return raw.select(F.substring_index(F.col("path"), root + "/", -1).alias("name"), F.sha2("content", 256).alias("h"))


def vectors(spark: SparkSession, path: str, ids: DataFrame, dim: int) -> DataFrame:
    """vec_id, embedding out of raw rows of ``dim`` half floats; ``ids`` has (row, vec_id) and must fit the file's rows.

    The file is read in records of one vector, so it is split over tasks.
    """
    import numpy as np

    raw = spark.sparkContext.binaryRecords(path, 2 * dim).zipWithIndex().map(lambda x: (x[1], np.frombuffer(x[0], np.float16).astype(float).tolist()))
    rows = spark.createDataFrame(raw, "row long, embedding array<float>")
    have, want = rows.count(), ids.count()
    if have != want:
        raise ValueError(f"{have} vectors for {want} ids")
    return ids.join(rows, "row").select("vec_id", "embedding")


def looked_up(chunk_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted chunks (chunk_id); raises if one is missing or stored twice."""
    found = chunk_table.join(wanted.select("chunk_id").distinct(), "chunk_id")
    n, d, asked = found.count(), found.select("chunk_id").distinct().count(), wanted.select("chunk_id").distinct().count()
    if not n == d == asked:
        raise ValueError(f"{asked} chunks wanted, {d} found in {n} rows")
    return found


def query_maps(df: DataFrame, depth: int = 2, rows: int = 20, keys: int = 100, pattern: str | None = None) -> list[str]:
    """Names of the fields, nested up to ``depth``, that are maps from a query id to something.

    With ``pattern`` a field counts only if most of the first ``keys`` keys of its first ``rows`` rows look like it.
    """
    from pyspark.sql import types as T

    out: list[str] = []

    def walk(kind, name: str, left: int) -> None:
        if isinstance(kind, T.MapType):
            out.append(name)
        elif isinstance(kind, T.StructType) and left >= 0:
            for f in kind.fields:
                walk(f.dataType, f"{name}.{f.name}" if name else f.name, left - 1)

    walk(df.schema, "", depth)
    if pattern is None or not out:
        return out
    some = df.limit(rows).select(*[F.avg(F.size(F.filter(F.slice(F.map_keys(c), 1, keys), lambda k: k.cast("string").rlike(pattern))) / F.nullif(F.least(F.size(c), F.lit(keys)), F.lit(0))).alias(f"c{i}") for i, c in enumerate(out)]).head()
    return [c for c, share in zip(out, some) if share is not None and share > 0.5]


def tree_hash(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 over the ordered relative names and digests of a folder's files. One short row per file is gathered."""
    each = file_hashes(spark, path)
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat(x["name"], F.lit(":"), x["h"])), "\n"), 256).alias("tree"))

"""Line deduplication by a log-template tree. DataFrame functions only.

A line's words are parsed as a log message: words that hold a digit are variable fields (``<*>``), the first levels of
the tree are the number of words and the first ``DEPTH`` words, and a leaf holds templates. Within a leaf lines are
merged by similarity: the words after the lead are cut into four quarters, and a line belongs to its own template and
to each in which the words of one or two quarters are variable fields too, as long as a share ``constant`` of all its
words stays. So two lines of a leaf have a template in common whenever they differ in the words of two quarters at
most. A template recurs if it occurs in at least ``min_docs`` documents; lines of a recurring template are dropped, but
for the document that has it first (smallest doc_id), so one copy of every passage stays.

This is the tree of fixed depth with clusters made order-free: a leaf's clusters are keyed by what stays constant, so
they are counted by one aggregation instead of being grown one line after another. Templates are told apart by 64 bits
besides nothing else: among t different templates about t^2 / 2^65 pairs share a key, and such a pair can only make
templates recur that alone would not.

Defined results: null texts count as empty; blank lines and lines under ``min_words`` words always stay; repeats within
one document stay; rows with a null id count as documents and come last; rows repeated in full count as often as they
occur and share a result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecraft.llm.names import fresh
from sievecraft.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
VARIABLE = "<*>"
DEPTH = 2


def template_keys(words: Column, min_words: int = 3, constant: float = 0.5) -> Column:
    """Hashes of the most general templates a line with these words belongs to.

    Lines that share a template also share each more general one of theirs, so the others need no keys: one quarter
    counts alone only where no second one has room, the whole line only where no quarter has.
    """
    n = F.size(words)
    m = n - DEPTH
    cut = [F.floor(q * m / 4).cast("int") for q in range(5)]
    size = [cut[q + 1] - cut[q] for q in range(4)]
    lead, quarter = F.slice(words, 1, DEPTH), [F.slice(words, cut[q] + DEPTH + 1, size[q]) for q in range(4)]
    room = F.floor(n - constant * n + 1e-9)
    both = {(i, j): (size[i] > 0) & (size[j] > 0) & (size[i] + size[j] <= room) for i in range(4) for j in range(i + 1, 4)}
    one = [(size[i] > 0) & (size[i] <= room) for i in range(4)]
    kept = lambda *gone: F.xxhash64(n, F.lit(4 * gone[0] + gone[-1]), lead, *[quarter[q] for q in range(4) if q not in gone])
    out = [F.when(ok, kept(i, j)) for (i, j), ok in both.items()]
    for i in range(4):
        paired = [ok for ij, ok in both.items() if i in ij]
        out.append(F.when(one[i] & ~(paired[0] | paired[1] | paired[2]), kept(i)))
    out.append(F.when(~(one[0] | one[1] | one[2] | one[3]), F.xxhash64(n, F.lit(-1), words)))
    return F.when(n >= min_words, F.array_compact(F.array(*out))).otherwise(F.array().cast("array<bigint>"))


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_words: int, constant: float) -> DataFrame:
    """doc_id, th (hash of the text, which tells rows of one id apart), keys: for each line its template hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    field = lambda w: F.when(w.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(w)
    words = F.transform(F.split(text, "\n"), lambda x: F.transform(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), field))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), words.alias("w")).select("doc_id", "th", F.transform("w", lambda w: template_keys(w, min_words, constant)).alias("keys"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_words: int = 3, constant: float = 0.5) -> DataFrame:
    """One row per input row, with its columns as they are but for the text: the lines that stay. Adds n_lines and n_dropped.

    Columns of the input named n_lines or n_dropped are replaced; other names do not matter.
    """
    t, i, h, g = fresh(docs.columns, "t", "i", "h", "g")
    keyed = checkpointed(line_keys(docs, id_col, text_col, min_words, constant))
    # Each row names a template once, so a plain count is a count of documents and combines before the shuffle.
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    recurring = (
        keyed.select(rank.alias("d"), F.explode(F.array_distinct(F.flatten("keys"))).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("d").alias("first"))
        .where(F.col("n") >= min_docs)
        .select("key", "first")
    )
    placed = keyed.select("doc_id", "th", F.posexplode("keys").alias("at", "ks")).select("doc_id", "th", "at", F.explode("ks").alias("key"))
    later = placed.join(recurring, "key").where(F.col("first") < rank)
    dropped = later.groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")]).withColumn(t, F.xxhash64(text))
    gone = dropped.select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("gone").alias(g))
    joined = base.join(gone, base[id_col].eqNullSafe(F.col(i)) & (F.col(t) == F.col(h)), "left")
    lines = F.split(text, "\n")
    # The lines are bound to a lambda variable: as a column they might be put in place of it and be split anew for every line.
    kept_of = lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(g)), lambda at: F.get(ls, at))
    kept = F.get(F.transform(F.array(lines), lambda ls: F.concat_ws("\n", kept_of(ls))), F.lit(0))
    out = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size(g), F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(F.col(g).isNull(), F.col(text_col)).otherwise(kept))
    return out.drop(t, i, h, g)

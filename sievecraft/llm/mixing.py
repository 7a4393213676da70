"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents, shuffled by a hash of their ids, form a stream of words that is cut into equal blocks. The
schedule has one slot per block to take: slot i has the golden-ratio point frac(i * phi) (in integers), which falls
into one source's part of the cumulative weights, and the slot's rank among the slots of its source says which block it
takes. So any stretch of the schedule holds the sources in their shares, and every source's total is its target to the
word: slots beyond a target are cut off, and the few that the points leave over come at the end.

Nothing is gathered in one task: places in a stream and ranks in a source are two-level prefix sums, over 4096 hash
buckets or slot ranges per source and then within these, so a source with a third of all rows is spread like others.

Defined results: null texts have size 0 and take nothing; a null source is a source of its own, last in order; rows
repeated in full are rows of their own; an empty table gives an empty result; with no words every target is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievecraft.llm.names import fresh
from sievecraft.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: frac(i * golden ratio) as pmod(i * STEP, PERIOD) / PERIOD.
PERIOD, STEP = 1 << 31, 1327217885
PARTS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, most: int = 2) -> DataFrame:
    """s (order of the source by code point, null last), source, source_size, target, goal (whole words), one row a source.

    Targets follow the weights; none exceeds ``most`` times its source's size, and what a full source cannot take goes
    to the others by weight. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("s", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("long")).withColumn("full", most * F.col("source_size"))
    before = W.orderBy(F.col("full") / F.col("w"), "s").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    gone, wgone = F.coalesce(F.sum("full").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    rate = (total_share * F.sum("source_size").over(everything) - gone) / (F.sum("w").over(everything) - wgone)
    per = per.withColumn("rate", rate).withColumn("level", F.max("rate").over(everything))
    target = F.when(F.col("rate") > F.col("full") / F.col("w"), F.col("full").cast("double")).otherwise(F.col("level") * F.col("w")).cast("double")
    return per.withColumn("target", target).select("s", "source", "source_size", "target", F.least(F.floor(F.col("target") + 1e-6), "full").cast("long").alias("goal"))


def placed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> tuple[DataFrame, DataFrame]:
    """(documents with s, size and their start in the source's shuffled stream; the sources), both checkpointed."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.col(text_col)).alias("th"), F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":mix")).cast("binary")).alias("key")))
    sources = checkpointed(source_targets(sizes, **how))
    part = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    keyed = sizes.withColumn("part", part)
    sums = keyed.groupBy("source", "part").agg(F.sum("size").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    base = base.select(F.col("source").alias("bs"), F.col("part").alias("bp"), "base")
    inside = W.partitionBy("source", "part").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "th").rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(base, F.col("source").eqNullSafe(F.col("bs")) & (F.col("part") == F.col("bp"))).withColumn("start", F.col("base") + F.col("inside"))
    named = sources.select("s", F.col("source").alias("ss"), "source_size", "target", "goal")
    out = placed.join(named, F.col("source").eqNullSafe(F.col("ss")))
    return checkpointed(out.select("doc_id", "th", "size", "s", "start", "source_size", "target", "goal")), sources


def slot_schedule(sources: DataFrame, block: int = 128) -> DataFrame:
    """slot, s, rank: which block of which source each slot takes."""
    spark = sources.sparkSession
    k = F.ceil(F.col("goal") / block).cast("long")
    need = sources.select("s", k.alias("k"))
    total = int(need.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0])
    if not total:
        return spark.createDataFrame([], "slot long, s int, rank long")
    upto = F.sum("k").over(W.orderBy("s"))
    point = lambda c: F.floor(c.cast("decimal(38,0)") * PERIOD / F.lit(total).cast("decimal(38,0)")).cast("long")
    shares = need.where("k > 0").withColumn("hi", point(upto)).withColumn("lo", point(upto - F.col("k"))).where("lo < hi")
    cell = PERIOD // PARTS
    cells = shares.select("s", "k", "lo", "hi", F.explode(F.sequence((F.col("lo") / cell).cast("int"), ((F.col("hi") - 1) / cell).cast("int"))).alias("cell"))
    span = total // PARTS + 1
    slots = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(PERIOD)) * F.lit(STEP), F.lit(PERIOD)).alias("u"))
    slots = slots.select("slot", "u", (F.col("u") / cell).cast("int").alias("cell"), F.floor(F.col("slot") / span).cast("int").alias("span"))
    mine = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "s", "k", "span")
    local = mine.withColumn("r", F.row_number().over(W.partitionBy("s", "span").orderBy("slot")) - 1)
    counts = mine.groupBy("s", "span").agg(F.count("*").alias("n"))
    first = counts.select("s", "span", F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    ranked = local.join(first, ["s", "span"]).select("slot", "s", "k", (F.col("first") + F.col("r")).alias("rank")).where("rank < k")
    have = counts.groupBy("s").agg(F.sum("n").alias("have"))
    short = need.join(have, "s", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < k")
    # The few that the points leave over follow at the end, sources in turn, without gaps that would stretch the schedule.
    places = need.count()
    rest = short.select("s", "have", F.explode(F.sequence(F.col("have"), F.col("k") - 1)).alias("rank"))
    return ranked.select("slot", "s", "rank").unionByName(rest.select((total + (F.col("rank") - F.col("have")) * places + F.col("s")).alias("slot"), "s", "rank"))


def mixed_spans(placed: DataFrame, sources: DataFrame, block: int = 128) -> DataFrame:
    """slot, s, rank, doc_id, start (names the row within its source), epoch, word_from, word_to: what each slot takes."""
    epochs = placed.where("size > 0").select("doc_id", "s", "start", "size", "source_size", "goal", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("goal") / F.col("source_size")).cast("int") - 1, F.lit(0)))).alias("epoch"))
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    live = epochs.withColumn("at", at).withColumn("to", F.least(at + F.col("size"), "goal")).where("at < to")
    pieces = live.select("doc_id", "s", "start", "epoch", "at", "to", F.explode(F.sequence(F.floor(F.col("at") / block).cast("long"), F.floor((F.col("to") - 1) / block).cast("long"))).alias("rank"))
    return pieces.join(slot_schedule(sources, block), ["s", "rank"]).select(
        "slot", "s", "rank", "doc_id", "start", "epoch",
        (F.greatest(F.col("at"), F.col("rank") * block) - F.col("at")).alias("word_from"),
        (F.least(F.col("to"), (F.col("rank") + 1) * block) - F.col("at")).alias("word_to"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 128, **how) -> DataFrame:
    """One row per input row: doc_id, th, size, source_size, target, taken and, for each epoch, the words taken and the first slot."""
    placed, sources = placed_documents(docs, id_col, text_col, source_col, **how)
    spans = mixed_spans(placed, sources, block)
    taken = spans.groupBy("s", "start", "epoch").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n"), F.min("slot").alias("slot"))
    rows = taken.groupBy("s", "start").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list(F.struct("epoch", "n", "slot"))).alias("epochs"))
    full = placed.where("size > 0").join(rows, ["s", "start"], "left").unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return full.select("doc_id", "th", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "epochs")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each document and epoch, its text being the words taken.

    Rows come in the order of the schedule, by the first slot that takes words of theirs: the partitions are stretches
    of the schedule and are sorted within, so any stretch of the output holds the sources in their shares. Whole
    documents keep their text unchanged; of a document on the edge of a target the first words are kept. Documents
    without a word have nothing to take and give no row. Columns are kept, whatever they are called.
    """
    t, k, i, h, n, size, e = fresh(docs.columns, "t", "k", "i", "h", "n", "size", "e")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = checkpointed(mix(docs, **how).where("taken > 0"))
    last = taken.agg(F.max(F.array_max("epochs.slot"))).first()[0]
    twin = W.partitionBy("doc_id", "th").orderBy(F.lit(1))
    taken = taken.withColumn(n, F.row_number().over(twin)).select(F.col("doc_id").alias(i), F.col("th").alias(h), n, F.col("size").alias(size), F.explode("epochs").alias(e))
    base = docs.withColumn(t, F.xxhash64("text")).withColumn(k, F.row_number().over(W.partitionBy("doc_id", t).orderBy(F.lit(1))))
    joined = base.join(taken, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(t) == F.col(h)) & (F.col(k) == F.col(n)))
    part = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col(f"{e}.n").cast("int")))
    text = F.when(F.col(f"{e}.n") == F.col(size), F.col("text")).otherwise(part)
    out = joined.withColumn("text", text)
    if last is not None:
        out = out.repartitionById(parts, F.floor(F.col(f"{e}.slot") * parts / (last + 1)).cast("int")).sortWithinPartitions(f"{e}.slot", f"{e}.epoch")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

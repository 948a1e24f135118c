"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.llm.common import DOCUMENT, n_words, pick, ranked, running_start, same, stored

#: The golden ratio's fraction in 32 bits, and the weights dealt to sources in order.
GOLDEN = 2654435769
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def points(slot: Column) -> Column:
    """Golden-ratio points of a slot number in 32 bits; the product is taken in two halves, so that it never overflows."""
    slot = F.pmod(slot, F.lit(1 << 32))
    high, low = F.floor(slot / 65536), F.pmod(slot, F.lit(65536))
    return F.pmod(F.pmod(high * GOLDEN, F.lit(65536)) * 65536 + low * GOLDEN, F.lit(1 << 32))


def source_targets(docs: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size). Sources in code-point order, null last, weigh 5, 2, 1, repeating. Targets
    share the size of all sources by weight; one that would be above `MAX_EPOCHS` times its source stops there, and the excess is shared
    again by weight until none is above. One row per source; the driver sees sums only."""
    sizes = stored(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    numbered = ranked(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"])
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int"))
    weighed = stored(numbered.select("source", "source_size", weight.alias("weight")), "weights")
    limit = F.col("source_size") * MAX_EPOCHS
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share = None  # words for a weight of one, as a fraction
    over = lambda x: limit / F.col("weight") < F.lit(x[0] / x[1])
    while True:
        capped = F.lit(False) if share is None else over(share)
        taken, weight = weighed.agg(F.sum(F.when(capped, limit).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        new = (total - (taken or 0), weight or 0)
        if not new[1] or new == share:
            share = share or (0, 1)
            break
        share = new
    even = F.col("weight") * F.lit(float(share[0])) / F.lit(float(share[1]))
    return weighed.select("source", "source_size", F.when(over(share), limit.cast("double")).otherwise(F.least(even, limit.cast("double"))).alias("target"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, source, rank, words): slot k goes to the source whose part of the cumulative targets holds point k; rank numbers the
    slots of a source in slot order. Each slot but a source's last is worth `block` words; the slots end where the target is reached, and
    slots that the points leave a source short of are added after all others, so the words of a source are its rounded target."""
    spark = targets.sparkSession
    rows = targets.select("source", F.round("target").cast("long").alias("words")).filter("words > 0")
    total = rows.agg(F.sum("words")).first()[0] or 0
    slots = -(-total // block)
    wide = 1 << 32
    cells = 1 << max(0, min(20, (max(slots, 1) // 4096).bit_length()))  # of about 4096 points
    cell_width = wide // cells
    order = rows.withColumn("place", F.pmod(F.xxhash64("source"), F.lit(1 << 20)))
    grouped = order.groupBy("place").agg(F.sum("words").alias("all"))
    starts = running_start(grouped, [], "place", "all", "place_start").select("place", "place_start")
    inner = Window.partitionBy("place").orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("place_start") + F.coalesce(F.sum("words").over(inner), F.lit(0))
    parts = order.join(starts, "place").select("source", "words", begin.alias("begin"))
    at = lambda c: F.floor(c.cast("double") / F.lit(float(max(total, 1))) * float(wide)).cast("long")
    parts = parts.select("source", "words", at(F.col("begin")).alias("lo"), F.least(at(F.col("begin") + F.col("words")), F.lit(wide)).alias("hi")).filter("hi > lo")
    marks = parts.select("source", "lo", F.explode(F.sequence(F.floor(F.col("lo") / cell_width), F.floor((F.col("hi") - 1) / cell_width))).alias("cell"))
    marks = marks.select("cell", F.greatest(F.col("lo"), F.col("cell") * cell_width).alias("u"), F.lit(None).cast("long").alias("slot"), F.struct("source").alias("s"))
    dealt = spark.range(slots).select(F.col("id").alias("slot"), points(F.col("id")).alias("u"))
    dealt = dealt.select(F.floor(F.col("u") / cell_width).alias("cell"), "u", "slot", F.lit(None).cast(marks.schema["s"].dataType).alias("s"))
    held = F.last("s", ignorenulls=True).over(Window.partitionBy("cell").orderBy("u", F.col("slot").isNotNull(), "slot"))
    dealt = marks.unionByName(dealt).withColumn("s", held).filter(F.col("slot").isNotNull()).select("slot", F.col("s.source").alias("source"))
    span = 1 << 16  # slots ranked together
    dealt = stored(dealt.withColumn("span", F.floor(F.col("slot") / span)), "slots")
    counts = dealt.groupBy("source", "span").agg(F.count("*").alias("n"))
    starts = running_start(counts, ["source"], "span", "n", "start").select("source", "span", "start")
    rank = F.row_number().over(Window.partitionBy("source", "span").orderBy("slot")) - 1
    ranked = same(dealt.withColumn("own", rank), starts, ["source", "span"]).select("slot", "source", (F.col("start") + F.col("own")).alias("rank"))
    got = counts.groupBy("source").agg(F.sum("n").alias("got"))
    need = rows.withColumn("need", F.ceil(F.col("words") / block))
    short = same(need, got, ["source"], "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("need > got")
    extra = short.select(F.lit(slots).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    worth = F.least(F.lit(block), F.col("words") - F.col("rank") * block)
    both = ranked.unionByName(extra)
    return same(both, need.select("source", "words", "need"), ["source"]).filter("rank < need").select("slot", "source", "rank", worth.alias("words"))


def streams(docs: DataFrame, seed: int, bucket_words: int) -> DataFrame:
    """`docs` (with source, size) with `begin`, where a document starts in the shuffled words of its source. Those without words, which
    may be any share of a source, take no place and no part in the sums; they begin at 0."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash"))
    total = docs.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_words))
    rows = docs.filter("size > 0").withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
    counts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    starts = running_start(counts, ["source"], "bucket", "n", "start").select("source", "bucket", "start")
    before = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = same(rows.withColumn("own", own), starts, ["source", "bucket"]).withColumn("begin", F.col("start") + F.col("own")).drop("own", "start", "bucket", "draw")
    return placed.unionByName(docs.filter("size = 0").withColumn("begin", F.lit(0).cast("long")))


def numbered(docs: DataFrame, *others: str) -> DataFrame:
    """The rows to mix, numbered: row, doc_id, source, size, text_hash and the other columns asked for."""
    rows = pick(docs, *dict.fromkeys(("doc_id", "text", "source", *others))).withColumn("size", n_words(F.col("text"))).withColumn("text_hash", F.xxhash64("text"))
    return stored((rows if "text" in others else rows.drop("text")).withColumn("row", F.monotonically_increasing_id()), "rows")


def mixed(rows: DataFrame, block: int = 4096, seed: int = 5, bucket_words: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """`numbered` rows -> (documents, pieces).

    documents: row, doc_id, source, size, source_size, target, begin. pieces: (slot, source, rank, row, from_word, to_word), the words
    each slot of the schedule takes from a document: slot `rank` of a source is words [rank * block, ...) of its shuffled documents laid
    end to end, again from the start when they are used up, at most `MAX_EPOCHS` times. Everything follows from hashes of ids and texts,
    so reruns agree; a hot source is cut into buckets before any prefix sum. Null texts have no words, null is a source, the last.
    Repeated rows are documents of their own. Documents without words take no part; a table without rows gives none."""
    rows = rows.select("row", "doc_id", "source", "size", "text_hash")
    targets = stored(source_targets(rows), "targets")
    documents = stored(same(streams(rows, seed, bucket_words).drop("text_hash"), targets, ["source"]), "streams")
    plan = schedule(targets, block)
    epochs = same(plan, targets.select("source", "source_size"), ["source"]).withColumn("first", F.col("rank") * block)
    # A slot is words [first, first + words) of the repeated stream: at most two epochs unless the source is shorter than a block.
    epoch = F.explode(F.sequence(F.floor(F.col("first") / F.col("source_size")), F.floor((F.col("first") + F.col("words") - 1) / F.col("source_size"))))
    epochs = epochs.withColumn("epoch", epoch)
    start = F.greatest(F.col("first"), F.col("epoch") * F.col("source_size")) - F.col("epoch") * F.col("source_size")
    end = F.least(F.col("first") + F.col("words"), (F.col("epoch") + 1) * F.col("source_size")) - F.col("epoch") * F.col("source_size")
    asked = epochs.select("slot", "source", "rank", start.alias("start"), end.alias("end"))
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / block), F.floor((b - 1) / block)))
    asked = asked.withColumn("cell", cell(F.col("start"), F.col("end")))
    offered = documents.filter("size > 0").select("source", "row", "begin", (F.col("begin") + F.col("size")).alias("stop")).withColumn("cell", cell(F.col("begin"), F.col("stop")))
    met = same(asked, offered, ["source", "cell"])
    low, high = F.greatest(F.col("start"), F.col("begin"), F.col("cell") * block), F.least(F.col("end"), F.col("stop"), (F.col("cell") + 1) * block)
    pieces = met.select("slot", "source", "rank", "row", (low - F.col("begin")).alias("from_word"), (high - F.col("begin")).alias("to_word")).filter("to_word > from_word")
    return documents, pieces


def taken(rows: DataFrame, **settings: int) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken) for each of the `numbered` rows."""
    documents, pieces = mixed(rows, **settings)
    used = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return documents.join(used, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def repeated(docs: DataFrame, **settings: int) -> DataFrame:
    """The columns of documents, each document as many times as the mix takes it. Only where a source's target ends within a document
    is it taken in part; there the nearer whole number counts."""
    rows = numbered(docs, *DOCUMENT)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    copies = taken(rows, **settings).filter("size > 0 AND taken > 0").select("row", times.alias("times")).filter("times > 0")
    return rows.join(copies, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*DOCUMENT)

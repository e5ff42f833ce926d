"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are laid one after the other in an order shuffled by a hash of the id, and this stream,
repeated without end, is cut into blocks of BLOCK words. Slot n of the schedule falls on the point n * golden ratio mod 1;
cumulative target weights map the point to a source, and the rank of the slot among its source's slots names the block
that it plays. The slots so give the order of the mix, in which sources alternate evenly at every scale: `slot` is the first that plays a document. A
source ends at its target: its last block is cut there, later slots of it are passed over, and the few blocks that the
points still owe a source when all slots are dealt follow in further slots.

Ranks and running totals are made in two levels (chunks or hash buckets, then inside them), so a hot source isn't one task. Only the table of sources
is sorted as a whole.

Targets: weights repeat over the sources by code point, null last. 150 % of all words are shared by weight; no target is
above twice its source's words, and the excess is shared again among the others.

Defined cases: null, empty and blank texts have size 0, take 0 and have no slot. A source of size 0 has target 0. Rows that repeat an id are
separate. Ties go by id and size. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_one, table

BLOCK = 256
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BUCKETS = 4096
CHUNK = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
#: Golden ratio as a multiplier of 32 bits: multiples of it mod 2**32 are spread evenly.
GOLDEN = 2654435769


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes has source and size, a row each; adds sid (order of sources), weight and target. Windows run over the sources alone."""
    order, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    rows = sizes.withColumn("sid", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1)).withColumns({"cap": F.col("size") * float(repeats), "budget": F.sum("size").over(whole) * float(share)})
    by = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rows = rows.withColumns({"before": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rest": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    rows = rows.withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # the first source that isn't full sets the level of all that follow it
    rows = rows.withColumn("at", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "sid"))).over(whole))
    return rows.select("source", "size", "sid", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * F.col("at")).alias("target"))


def laid(docs: DataFrame) -> DataFrame:
    """docs has doc_id, sid and size; adds start, the words of its source before it in shuffled order."""
    rows = docs.withColumn("order", F.xxhash64("doc_id", F.lit("mix"))).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).drop("words")
    inside = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(sums, ["sid", "bucket"])
    return rows.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("bucket", "order", "upto", "base")


def schedule(needs: DataFrame, scratch: Scratch) -> DataFrame:
    """slot, sid and rank: needs has sid and blocks, the blocks wanted; each sid gets the ranks 0 to blocks - 1."""
    spark = needs.sparkSession
    upto = F.sum("blocks").over(Window.orderBy("sid"))
    needs = scratch.keep(needs.withColumn("upto", upto), "needs")
    found = needs.agg(F.max("upto").alias("total"), F.count("*").alias("n")).first()
    total = found["total"] or 0
    # a source's part of the points, cut where the points' leading bits change: with four cells a source, a slot meets few sources
    shift = 32 - min(30, (4 * found["n"]).bit_length())
    bound = lambda x: F.floor(x.cast("decimal(38,0)") * (1 << 32) / max(total, 1)).cast("long")
    parts = needs.withColumns({"lo": bound(F.col("upto") - F.col("blocks")), "hi": bound(F.col("upto"))}).where("lo < hi")
    parts = parts.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift)))).drop("upto")
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * GOLDEN, F.lit(1 << 32))
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"), F.shiftright(point, shift).alias("cell"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    slots = slots.join(parts, "cell").where("point >= lo and point < hi").select("slot", "sid", "blocks", "chunk")
    counts = scratch.keep(slots.groupBy("sid", "chunk").agg(F.count("*").alias("n")), "chunks")
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    slots = slots.withColumn("place", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(base, ["sid", "chunk"])
    ranked = slots.withColumn("rank", F.col("base") + F.col("place")).where("rank < blocks").select("slot", "sid", "rank")
    owed = needs.join(counts.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    owed = owed.select("sid", "n", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank"))
    return ranked.unionByName(owed.select(((F.col("rank") - F.col("n")) * found["n"] + F.col("sid") + total).alias("slot"), "sid", "rank"))


def plan(docs: DataFrame, scratch: Scratch, block: int = BLOCK, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """docs has doc_id, source, text and what to carry. (rows laid out with their targets; pieces: slot, sid, start, epoch, words of a document a slot takes)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    sized = scratch.keep(docs.select("doc_id", *carry, "source", key.alias("of"), size_of(F.col("text")).alias("size")), "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, share, repeats)
    goal = F.least(F.floor(F.col("target") + 0.5), F.col("size") * repeats)
    sources = scratch.keep(sources.select(key.alias("of"), "sid", F.col("size").alias("source_size"), "target", goal.cast("long").alias("goal")), "sources")
    rows = join_one(sized, sources, "of", scratch).select("doc_id", *carry, "sid", "size", "source_size", "target", "goal")
    rows = scratch.keep(laid(rows), "laid")
    slots = schedule(sources.where("goal > 0").select("sid", F.ceil(F.col("goal") / block).alias("blocks")), scratch)
    epochs = rows.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    spans = epochs.withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("goal"))).where("lo < hi")
    pieces = spans.withColumn("rank", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    pieces = pieces.withColumn("words", F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block))
    return rows, pieces.select("sid", "rank", "start", "epoch", "words").join(slots, ["sid", "rank"]).select("slot", "sid", "start", "epoch", "words")


def mix(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and slot (the first that plays it) of every row of docs."""
    rows, pieces = plan(docs, scratch or Scratch(docs.sparkSession, "mix"), **options)
    taken = pieces.groupBy("sid", "start").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("slot"))
    some = rows.where("size > 0").join(taken, ["sid", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    none = rows.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "slot": F.lit(None).cast("long")})
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "slot")


def played(docs: DataFrame, name: str, scratch: Scratch, **options) -> DataFrame:
    """`name` (a column of docs that numbers its rows), epoch and slot of each time that the mix plays a document, at least half of it."""
    rows, pieces = plan(docs, scratch, carry=(name,), **options)
    times = pieces.groupBy("sid", "start", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    return rows.where("size > 0").join(times, ["sid", "start"]).where("2 * words >= size").select(name, "epoch", "slot")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))

"""Sharding: size-weighted key samples give splitters, records are range-partitioned, overfull ranges subdivided.

Law `bytes`: shards hold nearly equal bytes. Records are ordered by (CRC-32 of the text, hash of the id), so equal
texts are neighbours and a large group of copies is cut only where a shard ends. A sample drawn with probability in
proportion to size gives splitters for RANGES ranges; ranges with more than twice their part are sampled again
more densely and subdivided, until each of them is one key. A shard is a run of whole ranges: a range goes where the middle of its bytes
falls, so a shard is within two ranges' bytes (some 0.1 % of all, or one record, if that is larger) of its part. Slots number a shard's records
range by range; only the ranges' totals are added up in one place.

Defined cases: a null text has size 1 and no CRC-32, and comes first; an empty text has size 1. Rows that are equal in id and
text are spread over neighbouring keys, and over ranges, by their place in the input. Ties go by id. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbered, table

SHARDS = 16
#: First ranges. Some five times as many splitters are the most that is sent to the driver, whatever the input.
RANGES = 4096
#: Rows of a shard that are written together.
SLICE = 100_000
#: Sampled keys for each range that a round wants.
OVERSAMPLE = 16


def _listed(numbers: list[int]) -> Column:
    """A constant array; folded to one literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters at or below the key, by binary search."""
    steps, width = [], 1
    while width <= len(splitters):
        steps.insert(0, width)
        width *= 2
    if not steps:
        return F.lit(0)
    bounds = _listed(splitters)
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def _cut(sample: DataFrame, pieces: Column) -> list[int]:
    """Of each range of the sample, which wants that many pieces: the first sampled key behind each full piece; a key that fills a piece is cut out."""
    by = Window.partitionBy("range").orderBy("key")
    keys = sample.groupBy("range", "key").agg(F.sum("weight").alias("weight"))
    rows = keys.withColumns({"before": F.sum("weight").over(by) - F.col("weight"), "piece": F.sum("weight").over(Window.partitionBy("range")) / pieces})
    first = rows.withColumn("part", F.floor(F.col("before") / F.col("piece"))).where("part > 0").groupBy("range", "part").agg(F.min("key").alias("key")).select("key")
    heavy = rows.where("weight >= piece").select(F.explode(F.array(F.col("key"), F.col("key") + 1)).alias("key"))
    return [r["key"] for r in first.unionByName(heavy).distinct().collect()]


def splitters(keyed: DataFrame, total: int, size: str = "size", ranges: int = RANGES) -> list[int]:
    """Keys that cut the records (key and size) into ranges of about total / ranges, none of them above twice that unless it is one key."""
    part, found, wanted = total / ranges, [], {0: ranges}
    density = OVERSAMPLE / part
    while True:
        ranged = keyed.withColumn("range", range_of(F.col("key"), found))
        # a record is drawn with probability size * density; a larger record is sure to be drawn and weighs as much more
        pieces = F.get(_listed([wanted.get(i, 0) for i in range(len(found) + 1)]), F.col("range"))
        drawn = ranged.where(pieces > 0).withColumn("p", F.col(size) * density)
        drawn = drawn.where(F.pmod(F.xxhash64("key", F.lit(len(found))), F.lit(1 << 30)) / (1 << 30) < F.col("p"))
        added = _cut(drawn.select("range", "key", F.greatest("p", F.lit(1.0)).alias("weight")), pieces)
        before, found = len(found), sorted({*found, *added})
        if len(found) == before and density >= 1:
            return found  # every record was drawn: what is overfull is a key that is
        full = keyed.groupBy(range_of(F.col("key"), found).alias("range")).agg(F.sum(size).alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        # at most ranges / 2 of them, for their bytes are above 2 * part each
        full = full.where((F.col("b") > 2 * part) & (F.col("lo") < F.col("hi"))).select("range", "b").collect()
        if not full:
            return found
        wanted = {r["range"]: int(2 * r["b"] // part) for r in full}
        density *= 4


def assign(records: DataFrame, scratch: Scratch, shards: int = SHARDS, key_of: tuple[str, str] = ("text_crc32", "doc_id"), size: str = "size", ranges: int = RANGES) -> DataFrame:
    """The records with shard and slot; records has doc_id, the size and the CRC-32, and no text."""
    major, minor = key_of
    columns = records.columns
    # 33 bits of the CRC-32, 20 of the id, 10 of the place for rows that repeat an id and a text
    key = F.coalesce(F.col(major) + 1, F.lit(0)) * (1 << 30) + F.pmod(F.xxhash64(minor), F.lit(1 << 20)) * (1 << 10) + F.pmod(F.xxhash64("place"), F.lit(1 << 10))
    keyed = scratch.keep(numbered(records, scratch, "place").withColumn("key", key), "keyed")
    total = keyed.agg(F.sum(size).alias("b")).first()["b"] or 0
    if not total:
        return keyed.select(*columns, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranged = keyed.withColumn("range", range_of(F.col("key"), splitters(keyed, total, size, ranges)))
    ranged = scratch.keep(ranged, "ranged")
    # the ranges are a bounded list: their running totals give the shards and each range's first slot
    sums = ranged.groupBy("range").agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    middle = F.sum("b").over(Window.orderBy("range")) - F.col("b") / 2
    sums = sums.withColumn("shard", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int"))
    sums = sums.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).select("range", "shard", "first")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("key", minor, "place")) - 1
    return ranged.withColumn("rank", rank).join(F.broadcast(sums), "range").select(*columns, "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of documents."""
    placed = assign(docs.select(*_slim()), scratch or Scratch(docs.sparkSession, "shard"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slim() -> list[Column]:
    return ["doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, scratch: Scratch | None = None) -> None:
    """Write whole documents, every row by itself whatever its id, into folders __shard=0 .., each file in the order of slots."""
    scratch = scratch or Scratch(docs.sparkSession, "write")
    rows = numbered(docs, scratch, "__row")
    placed = assign(rows.select("__row", *_slim()), scratch, shards).select("__row", F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    out = rows.join(placed, "__row").repartition(F.col("__shard"), F.floor(F.col("__slot") / SLICE)).sortWithinPartitions("__shard", "__slot")
    out.drop("__row", "__slot").write.partitionBy("__shard").parquet(path)


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

"""Shared pieces: table loading, held-out rows, numbered rows, joins that split hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.scratch import Scratch, shared_dir
from kinweave.shipping import ship

__all__ = ["Scratch", "held_out", "join_one", "numbered", "shared_dir", "ship", "table"]
#: A key with more than one in this many of a table's rows is hot; there can't be more such keys than this.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0. A null id counts as held out: nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def numbered(docs: DataFrame, scratch: Scratch, name: str = "uid") -> DataFrame:
    """docs with a number of its own for every row, written once, so that the numbers stay."""
    return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def join_one(many: DataFrame, one: DataFrame, key: str, scratch: Scratch, how: str = "inner", counted: str | None = None) -> DataFrame:
    """many joined with one: keys that are hot in many (HOT at most) are broadcast, so that no task gets all of their rows.

    one has a row for each key, or at most HOT for each hot key. many is read several times: give a table of the scratch folder, or a cheap
    projection of one. how is inner, left, left_semi or left_anti. counted names the column of one that holds many's rows by key, if it has one.
    """
    counts = one.select(key, F.col(counted).alias("__n")) if counted else scratch.keep(many.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= HOT), "counts")
    one = one.drop(counted) if counted else one
    most = counts.agg(F.max("__n").alias("m")).first()["m"] or 0
    total = many.count() if most >= HOT else 0
    if most < HOT or most <= total / HOT:
        return many.join(one, key, how)
    hot = F.broadcast(scratch.keep(counts.where((F.col("__n") >= HOT) & (F.col("__n") > total / HOT)).select(key), "hot"))
    few = F.broadcast(one.join(hot, key, "left_semi"))
    return many.join(hot, key, "left_semi").join(few, key, how).unionByName(many.join(hot, key, "left_anti").join(one, key, how))

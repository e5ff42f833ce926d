"""Corpus pipeline: language ID, MinHash near-dedup, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; the last returns the place of each kept row.

- language_id drops texts without a letter (null and empty ones too) and predictions below MIN_SCORE.
- near_dedup keeps one row, of the smallest id, of each group of near copies (five-word shingles, 0.8 or more).
- decontaminate drops documents that hold a passage of the benchmark.
- mix repeats or leaves out whole documents, so that sources come near their target words: a document goes out each time that
  the schedule plays at least half of it. Its rows are written in the order of the schedule's slots.
- shard gives each row its shard and slot by nearly equal bytes.

A stage drops what its result doesn't read; the tables that it reads stay with the application, so stages can be composed before any is run.

Rows count by themselves, not by id: rows that repeat an id and rows with a null id stay or go by their own texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontaminate as winnow
from kinweave.llm import language_id, minhash, mixing, sharding
from kinweave.llm.common import Scratch, held_out, numbered, shared_dir, table

MIN_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs.where(~held_out()))
    rows = docs.select(*COLUMNS, F.col("text").alias("scored"))
    kept = language_id.predict(rows, model, text="scored", carry=COLUMNS)
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "dedup")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # the numbers stay, and the copy goes with the last frame that reads it where spark.cleaner.referenceTracking.cleanCheckpoints says so
    rows = docs.select(*COLUMNS).withColumn("uid", F.monotonically_increasing_id()).checkpoint()
    found = minhash.near_duplicates(rows.select(F.col("uid").alias("doc_id"), "text"), scratch=scratch).select(F.col("doc_id").alias("uid"), "component_id")
    found = scratch.keep(found.join(rows.select("uid", "doc_id"), "uid"), "found")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"))
    first = scratch.keep(first.select("first.uid"), "kept")
    scratch.drop(but=("kept",))
    return rows.join(first, "uid", "left_semi").select(*COLUMNS)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "winnow")
    touched = scratch.keep(winnow.contaminated_rows(docs, table(spark, sf_dir, "benchmark"), scratch), "touched")
    scratch.drop(but=("touched",))
    return docs.select(*COLUMNS).withColumn("row", winnow.row_of()).join(touched, "row", "left_anti").select(*COLUMNS)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix")
    rows = numbered(docs.select(*COLUMNS), scratch)
    played = scratch.keep(mixing.played(rows, "uid", scratch), "played")
    scratch.drop(but=("numbered", "played"))
    return rows.join(played, "uid").repartitionByRange("slot", "uid").sortWithinPartitions("slot", "uid", "epoch").select(*COLUMNS)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, scratch=Scratch(spark, "shard"))


STAGES = [
    ("language_id", _language_id),
    ("near_dedup", _near_dedup),
    ("decontaminate", _decontaminate),
    ("mix", _mix),
    ("shard", _shard),
]

#: Language ID, MinHash and the schedule have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder and read again by the next."""
    between = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = between.keep(stage(spark, docs, sf_dir), name)
    return docs

"""Conflicts of a mapping: each source's candidates near its target, how exclusive each is, and a one-to-one choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

LEAST = 50


def options(mapping: DataFrame, near: DataFrame, scores: DataFrame, least: int = LEAST) -> DataFrame:
    """src_id, dst_id and score (rounded half to even) of what a mapped source may take: targets near its own (near: id, other) that score `least`, and its own.

    mapping has src_id, dst_id, score and found_via; anchors have no choice. scores has src_id, dst_id and score.
    """
    open_ = mapping.where("found_via <> 'Anchor'").select("src_id", F.col("dst_id").alias("id"))
    found = open_.join(near, "id").select("src_id", F.col("other").alias("dst_id")).distinct().join(scores, ["src_id", "dst_id"]).where(F.col("score") >= least)
    found = found.select("src_id", "dst_id", F.bround("score").cast("int").alias("score"))
    own = mapping.where("found_via <> 'Anchor'").select("src_id", "dst_id", F.col("score").cast("int").alias("score"))
    return found.unionByName(own.join(found, ["src_id", "dst_id"], "left_anti"))


def exclusive(found: DataFrame) -> DataFrame:
    """Adds exclusivity: the distance from the source's second best score, as a part of its best. A source's options are the few near its target."""
    by = Window.partitionBy("src_id").orderBy(F.desc("score"), "dst_id")
    ranked = found.withColumns({"best": F.first("score").over(by), "rank": F.row_number().over(by)})
    second = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("src_id")), F.lit(0))
    return ranked.select("src_id", "dst_id", "score", F.when(F.col("best") > 0, (F.col("score") - second) / F.col("best")).otherwise(0.0).alias("exclusivity"))


def choose(found: DataFrame, taken: DataFrame, scratch: Scratch) -> DataFrame:
    """The greedy one-to-one choice by exclusivity, then score, then ids; targets in `taken` (dst_id) are closed.

    No order over all pairs is needed: a pair that is the first of both its source and its target is chosen whatever else is, so each round
    takes all such pairs at once and closes their people.
    """
    # structs compare by their fields in turn
    order = F.struct((-F.col("exclusivity")).alias("e"), (-F.col("score")).alias("s"), "src_id", "dst_id")
    left = scratch.keep(found.join(taken.select("dst_id").distinct(), "dst_id", "left_anti").withColumn("o", order), "open")
    chosen = None
    while left.limit(1).count():
        first = left.groupBy("src_id").agg(F.min("o").alias("o")).select("o.*")
        both = first.join(left.groupBy("dst_id").agg(F.min("o").alias("o")).select("o.*"), ["e", "s", "src_id", "dst_id"], "left_semi")
        new = scratch.keep(both.select("src_id", "dst_id", (-F.col("s")).alias("score")), "chosen")
        chosen = new if chosen is None else chosen.unionByName(new)
        left = scratch.keep(left.join(new.select("src_id"), "src_id", "left_anti").join(new.select("dst_id"), "dst_id", "left_anti"), "open")
    return found.select("src_id", "dst_id", "score").where("false") if chosen is None else chosen


def resolve(mapping: DataFrame, near: DataFrame, scores: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The mapping with each source's chosen target and score; sources without a choice and anchors stay as they are."""
    scratch = scratch or Scratch(mapping.sparkSession, "resolve")
    found = scratch.keep(exclusive(options(mapping, near, scores)), "options")
    new = choose(found, mapping.where("found_via = 'Anchor'"), scratch).select("src_id", F.col("dst_id").alias("new_dst"), F.col("score").alias("new_score"))
    rows = mapping.join(new, "src_id", "left")
    return rows.withColumns({"dst_id": F.coalesce("new_dst", "dst_id"), "score": F.coalesce("new_score", "score")}).drop("new_dst", "new_score")

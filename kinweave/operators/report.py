"""What an alignment means for the target tree: people to add, with their relations to people already there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the new person's side: an unmatched person's relation to a matched one, in the order in which the first is primary.
PRIORITY = {"spouse": (0, "Spouse"), "parent": (1, "Child"), "child": (2, "Parent"), "sibling": (3, "Sibling")}


def high_confidence(mapping: DataFrame, least: int = 70) -> DataFrame:
    return mapping.where(F.col("score") >= least)


def relations(unmatched: DataFrame, links: DataFrame, mapping: DataFrame, least: int = 70) -> DataFrame:
    """src_id, relation, other, dst_id and rank: links (id, relation, other) from unmatched people to surely matched ones.

    Siblings count only for people without another relation. Rank 1 is the primary relation.
    """
    order, name = F.lit(9), F.col("relation")
    for key, (rank, said) in PRIORITY.items():
        order = F.when(F.col("relation") == key, rank).otherwise(order)
        name = F.when(F.col("relation") == key, said).otherwise(name)
    sure = high_confidence(mapping, least).select(F.col("src_id").alias("other"), "dst_id")
    rows = unmatched.select("id").join(links, "id").join(sure, "other").select("id", order.alias("order"), name.alias("relation"), "other", "dst_id")
    # a person's relations are few: they are ordered as an array
    each = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("order", "other", "relation", "dst_id"))).alias("all"))
    some = F.filter("all", lambda x: x["order"] < 3)
    return each.select("id", F.posexplode(F.when(F.size(some) > 0, some).otherwise(F.col("all"))).alias("pos", "e")).select(F.col("id").alias("src_id"), "e.relation", "e.other", "e.dst_id", (F.col("pos") + 1).alias("rank"))


def additions(relations_: DataFrame, people: DataFrame) -> DataFrame:
    """src_id, relation, dst_id (of the primary relation), n_relations and the new person's JSON, by src_id."""
    first = relations_.groupBy("src_id").agg(F.min(F.struct("rank", "relation", "dst_id")).alias("r"), F.count("*").alias("n_relations"))
    person = people.select(F.col("id").alias("src_id"), F.to_json(F.struct("first", "last", "gender", "birth_year")).alias("person"))
    return first.join(person, "src_id").select("src_id", F.col("r.relation").alias("relation"), F.col("r.dst_id").alias("dst_id"), "n_relations", "person")


def level_stats(mapping: DataFrame) -> DataFrame:
    return mapping.groupBy("level").agg(F.count("*").alias("n_mapped"), F.count_if(F.col("found_via") == "Child").alias("n_children"))


def write_json(additions_: DataFrame, path: str) -> None:
    additions_.write.mode("overwrite").json(path)


def confirm(store: DataFrame, decisions: DataFrame) -> DataFrame:
    """A store of decisions (src_id, dst_id, kind) with newer ones in place of older ones of the same source."""
    return store.join(decisions.select("src_id"), "src_id", "left_anti").unionByName(decisions)


def bands(mapping: DataFrame, low: int = 70, least: int = 50) -> DataFrame:
    """Each mapping's band: accept, ask or reject."""
    return mapping.withColumn("band", F.when(F.col("score") >= low, "accept").when(F.col("score") < least, "reject").otherwise("ask"))

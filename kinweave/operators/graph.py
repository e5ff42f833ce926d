"""Family graphs: relatives in one and two steps, three kinds of siblings, breadth-first depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parent_links(persons: DataFrame) -> DataFrame:
    """child and parent of persons (id, father_id, mother_id) that both exist."""
    both = persons.select(F.col("id").alias("child"), F.explode(F.array("father_id", "mother_id")).alias("parent")).where("parent is not null")
    return both.join(persons.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()


def couples(persons: DataFrame) -> DataFrame:
    """id and other of people with a child together."""
    pair = persons.where("father_id is not null and mother_id is not null").select("father_id", "mother_id").distinct()
    known = persons.select("id")
    pair = pair.join(known.select(F.col("id").alias("father_id")), "father_id", "left_semi").join(known.select(F.col("id").alias("mother_id")), "mother_id", "left_semi")
    return pair.select(F.col("father_id").alias("id"), F.col("mother_id").alias("other")).unionByName(pair.select(F.col("mother_id").alias("id"), F.col("father_id").alias("other")))


def siblings(persons: DataFrame, kind: str = "exact") -> DataFrame:
    """id and other: `exact` with the same two parents (either may be missing), `any` with one parent in common."""
    if kind == "exact":
        rows = persons.where("father_id is not null or mother_id is not null").select("id", F.coalesce("father_id", F.lit(-1)).alias("f"), F.coalesce("mother_id", F.lit(-1)).alias("m"))
        return rows.join(rows.withColumnRenamed("id", "other"), ["f", "m"]).where("id <> other").select("id", "other")
    links = parent_links(persons)
    return links.select(F.col("child").alias("id"), "parent").join(links.select(F.col("child").alias("other"), "parent"), "parent").where("id <> other").select("id", "other").distinct()


def relatives(persons: DataFrame) -> DataFrame:
    """id, relation and other in one step."""
    up = parent_links(persons)
    named = lambda df, name: df.select("id", F.lit(name).alias("relation"), "other")
    return (
        named(up.select(F.col("child").alias("id"), F.col("parent").alias("other")), "parent")
        .unionByName(named(up.select(F.col("parent").alias("id"), F.col("child").alias("other")), "child"))
        .unionByName(named(couples(persons), "spouse"))
        .unionByName(named(siblings(persons), "sibling"))
    )


#: Two steps that stay within two degrees of kinship.
TWO_STEPS = (("parent", "parent"), ("parent", "spouse"), ("child", "child"), ("child", "spouse"), ("sibling", "child"), ("parent", "sibling"))


def within_two(persons: DataFrame) -> DataFrame:
    """id and other: the person, one step, and TWO_STEPS."""
    one = relatives(persons)
    steps = persons.sparkSession.createDataFrame(TWO_STEPS, "relation string, second string")
    first = one.join(F.broadcast(steps), "relation").select("id", F.col("other").alias("middle"), "second")
    two = first.join(one.select(F.col("id").alias("middle"), F.col("relation").alias("second"), "other"), ["middle", "second"]).select("id", "other")
    return two.unionByName(one.select("id", "other")).unionByName(persons.select("id", F.col("id").alias("other"))).distinct()


def bfs(persons: DataFrame, anchor: int, most: int = 3) -> DataFrame:
    """id and depth of all within `most` steps of the anchor; each level is one join and an anti-join; levels are kept, or each would repeat those before it."""
    step = relatives(persons).select("id", "other").distinct().persist()
    seen = frontier = persons.where(F.col("id") == anchor).select("id", F.lit(0).alias("depth"))
    for depth in range(1, most + 1):
        reached = frontier.select("id").join(step, "id").select(F.col("other").alias("id")).distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)).persist()
        seen = seen.unionByName(frontier)
    return seen


def stats(persons: DataFrame) -> DataFrame:
    return persons.agg(F.count("*").alias("n_persons"), F.count_if(F.col("gender") == "Male").alias("n_male"), F.count_if(F.col("gender") == "Female").alias("n_female"), F.count("birth_year").alias("n_birth"), F.count("father_id").alias("n_father"))

"""The plan of adding a branch: a breadth-first order over a tree from a start person, and for each person the one already there to whom it is added.

people: id, father_id, mother_id, spouse_ids and child_ids (arrays, in order). All frontiers of a level move at once; who would be found by several is found by the first of
them in order, which a minimum of paths says, so the order equals that of a queue. Levels are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

SPOUSE, FATHER, MOTHER, STEP, CHILD = range(5)
#: To whom a new person is added first: its partner, then its child, then its father, then its mother.
RELATION = {SPOUSE: (0, "Partner"), CHILD: (1, "Parent"), FATHER: (2, "Child"), MOTHER: (3, "Child")}


def edges(people: DataFrame) -> DataFrame:
    """id, slot, at and other: relatives in the order in which they are visited, siblings not among them."""
    one = lambda c, slot: people.where(F.col(c).isNotNull()).select("id", F.lit(slot).alias("slot"), F.lit(0).alias("at"), F.col(c).alias("other"))
    many = lambda c, slot: people.select("id", F.lit(slot).alias("slot"), F.posexplode(c).alias("at", "other"))
    return many("spouse_ids", SPOUSE).unionByName(one("father_id", FATHER)).unionByName(one("mother_id", MOTHER)).unionByName(many("child_ids", CHILD))


def _step(frontier: DataFrame, links: DataFrame, steps: DataFrame, visited: DataFrame, scratch: Scratch) -> DataFrame:
    """id and path of those that a level finds. A father's other partners follow him where the mother isn't found by the same person."""
    path = F.concat("path", F.array(F.col("slot").cast("long"), F.col("at").cast("long")))
    offer = lambda rows: frontier.withColumnRenamed("id", "by").join(rows.withColumnRenamed("id", "by"), "by").select("by", "slot", F.col("other").alias("id"), path.alias("path")).join(visited, "id", "left_anti")
    first, later = scratch.keep(offer(links), "offers"), scratch.keep(offer(steps), "steps")
    extra, before = later.where("false"), -1
    while True:
        claims = scratch.keep(first.unionByName(extra).groupBy("id").agg(F.min(F.struct("path", "by", "slot")).alias("c")).select("id", "c.*"), "claims")
        of = lambda slot: claims.where(F.col("slot") == slot).select("by").distinct()  # noqa: B023, E731
        extra = scratch.keep(later.join(of(FATHER), "by", "left_semi").join(of(MOTHER), "by", "left_anti"), "extra")
        # what is settled stays so in order, so a repeated set is the last one
        now = extra.agg(F.sum(F.xxhash64("by", "id").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        if (now["s"], now["n"]) == before or (before == -1 and not now["n"]):
            return claims.select("id", "path")
        before = (now["s"], now["n"])


def branch_plan(people: DataFrame, start, created: list, max_depth: int, scratch: Scratch | None = None) -> DataFrame:
    """depth, path (its place in the order), src_id, related_id and relation of everyone that is added, from start, and rows without related_id for those that are passed over.

    created: ids that are there already (the anchor, and its partner if known); they are not visited. Who has no relative there at its turn is passed over, and its relatives aren't visited from it.
    """
    spark = people.sparkSession
    scratch = scratch or Scratch(spark, "branch")
    kind = people.schema["id"].dataType.simpleString()
    links = scratch.keep(edges(people), "links")
    steps = links.where(F.col("slot") == FATHER).select("id", F.col("other").alias("father")).join(links.where(F.col("slot") == SPOUSE).select(F.col("id").alias("father"), "at", "other"), "father")
    steps = scratch.keep(steps.select("id", F.lit(STEP).alias("slot"), "at", "other"), "fathers")
    rank, said = F.lit(None).cast("int"), F.lit(None).cast("string")
    for slot, (order, name) in RELATION.items():
        rank, said = F.when(F.col("slot") == slot, order).otherwise(rank), F.when(F.col("slot") == slot, name).otherwise(said)
    ties = links.select("id", rank.alias("rank"), "at", F.col("other").alias("related_id"), said.alias("relation"))
    there = spark.createDataFrame([(x, [-1]) for x in created], f"id {kind}, path array<long>")
    visited = there.select("id").unionByName(spark.createDataFrame([(start,)], f"id {kind}"))
    frontier, plan = spark.createDataFrame([(start, [0])], f"id {kind}, path array<long>"), []
    for depth in range(max_depth + 1):
        frontier = scratch.keep(frontier.join(people.select("id"), "id", "left_semi"), "frontier")
        if not frontier.limit(1).count():
            break
        # relatives there before the level, or in it and earlier; who turns out to have none leaves, and may take others along
        standing = frontier
        while True:
            have = there.unionByName(standing).select(F.col("id").alias("related_id"), F.col("path").alias("p"))
            met = frontier.join(ties, "id").join(have, "related_id").where((F.size("p") < F.size("path")) | (F.col("p") < F.col("path")))
            chosen = scratch.keep(met.groupBy("id").agg(F.min(F.struct("rank", "at", "related_id", "relation")).alias("r")), "chosen")
            left = scratch.keep(frontier.join(chosen.select("id"), "id", "left_semi"), "standing")
            if left.count() == standing.count():
                break
            standing = left
        plan.append(frontier.join(chosen, "id", "left").select(F.lit(depth).alias("depth"), "path", F.col("id").alias("src_id"), F.col("r.related_id").alias("related_id"), F.col("r.relation").alias("relation")))
        there = scratch.keep(there.unionByName(standing), "there")
        frontier = _step(standing, links, steps, visited, scratch)
        visited = scratch.keep(visited.unionByName(frontier.select("id")), "visited")
    out = plan[0] if plan else frontier.select(F.lit(0).alias("depth"), "path", F.col("id").alias("src_id"), F.col("id").alias("related_id"), F.lit("").alias("relation")).where("false")
    for rows in plan[1:]:
        out = out.unionByName(rows)
    return out


def repair_frontier(persons_in_unions: DataFrame, anchor, max_depth: int, done: list | None = None, scratch: Scratch | None = None) -> DataFrame:
    """depth and id in the order of a repair walk: each expanded person's immediate family (all members of its unions) is visited once; ids in `done` are neither processed nor expanded again.

    persons_in_unions: union_id, id. Levels join members with members of the same union, each person once, by an anti-join with those before.
    """
    spark = persons_in_unions.sparkSession
    scratch = scratch or Scratch(spark, "repair")
    kind = persons_in_unions.schema["id"].dataType.simpleString()
    members = scratch.keep(persons_in_unions.select("union_id", "id").where("id is not null").distinct(), "members")
    frontier = seen = scratch.keep(spark.createDataFrame([(anchor, 0)], f"id {kind}, depth int"), "seen")
    skipped = spark.createDataFrame([(x,) for x in done or []], f"id {kind}")
    for depth in range(1, max_depth + 1):
        unions = members.join(frontier.select("id"), "id", "left_semi").select("union_id").distinct()
        found = members.join(unions, "union_id", "left_semi").select("id").distinct()
        frontier = scratch.keep(found.join(seen.select("id"), "id", "left_anti").join(skipped, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = scratch.keep(seen.unionByName(frontier), "seen")
    return seen.select("depth", "id")

"""Which union of a tree a new person belongs to: unions that hold all of a set of members, and the choice among them.

unions: union_id, status, partners and children (arrays of profile ids, in any spelling) and pos, their order in the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

EX = "ex_spouse"


def _ids(c: str):
    return F.array_distinct(F.transform(F.filter(c, lambda x: x.isNotNull()), names.profile_id))


def containing(unions: DataFrame, wanted: DataFrame, column: str = "partners") -> DataFrame:
    """key and union_id of the unions whose `column` holds every one of wanted's members (key, members). An empty set is held by none.

    Sets meet member by member, and a union holds a set that it meets as often as the set is large; a hot member is split by the join.
    """
    need = wanted.select("key", _ids("members").alias("members")).where(F.size("members") > 0).select("key", F.size("members").alias("n"), F.explode("members").alias("member"))
    held = unions.select("union_id", F.explode(_ids(column)).alias("member"))
    return need.join(held, "member").groupBy("key", "union_id").agg(F.count("*").alias("met"), F.first("n").alias("n")).where("met = n").select("key", "union_id")


def best(found: DataFrame, unions: DataFrame) -> DataFrame:
    """key, union_id, n_unions and is_ex: the first union in the tree's order that isn't an ended one; if all have ended, the first of them."""
    order = F.struct((F.lower(F.coalesce("status", F.lit(""))) == EX).alias("ex"), "pos", "union_id")
    rows = found.join(unions.select("union_id", order.alias("o")), "union_id").groupBy("key").agg(F.min("o").alias("o"), F.count("*").alias("n_unions"))
    return rows.select("key", F.col("o.union_id").alias("union_id"), "n_unions", F.col("o.ex").alias("is_ex"))


def for_children(unions: DataFrame, parents: DataFrame) -> DataFrame:
    """id, union_id, n_unions and is_ex for new children (id, father_profile, mother_profile): the best union of both parents; null where there is none, or only one parent is there."""
    both = parents.where("father_profile is not null and mother_profile is not null").select(F.col("id").alias("key"), F.array("father_profile", "mother_profile").alias("members"))
    two = both.where(F.size(_ids("members")) == 2)
    return parents.select("id").join(best(containing(unions, two), unions).withColumnRenamed("key", "id"), "id", "left")


def for_partners(unions: DataFrame, partners: DataFrame) -> DataFrame:
    """id and union_id for new partners (id, related_profile, children: profiles of their common children): the first union of the related person that holds one of the children and has room."""
    rows = partners.select("id", names.profile_id(F.col("related_profile")).alias("related"), F.explode(_ids("children")).alias("child"))
    room = unions.where(F.size(_ids("partners")) < 2)
    held = room.select("union_id", "pos", F.explode(_ids("partners")).alias("related"), _ids("children").alias("held"))
    held = held.select("union_id", "pos", "related", F.explode("held").alias("child"))
    found = rows.join(held, ["related", "child"]).groupBy("id").agg(F.min(F.struct("pos", "union_id")).alias("o")).select("id", F.col("o.union_id").alias("union_id"))
    return partners.select("id").join(found, "id", "left")

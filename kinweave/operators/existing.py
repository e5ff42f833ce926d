"""People about to be added who are in the target tree already, as relatives of those they would be added to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import solid


def plain(name: Column) -> Column:
    """Trimmed, pairs of blanks as one, in small letters."""
    return F.lower(F.replace(solid(name), F.lit("  "), F.lit(" ")))


def existing_relatives(additions: DataFrame, families: DataFrame, people: DataFrame) -> DataFrame:
    """src_id, dst_id, name and via of additions that a member of the relative's family may already be; the first such member in order.

    additions: src_id, first, last, dst_id (the relative); families: dst_id, at, member; people: id, first, last, maiden of the target. Given names must be equal where both have one; surnames
    where both have one, the member's birth name counting too. Families join by the relative, so work grows with the families, and the first hit is a minimum, not a sort.
    """
    member = people.select(F.col("id").alias("member"), *[F.col(c).alias(f"m_{c}") for c in ("first", "last", "maiden")])
    rows = additions.select("src_id", "first", "last", "dst_id").join(families, "dst_id").join(member, "member")
    a, b, mine, theirs, birth = plain(F.col("first")), plain(F.col("m_first")), plain(F.col("last")), plain(F.col("m_last")), plain(F.col("m_maiden"))
    fits = (a.isNull() | b.isNull() | (a == b)) & (mine.isNull() | theirs.isNull() | (mine == theirs) | F.coalesce(mine == birth, F.lit(False)))
    name = F.concat_ws(" ", solid(F.col("m_first")), solid(F.col("m_last")))
    hit = rows.where(fits).groupBy("src_id").agg(F.min(F.struct("dst_id", "at", "member", name.alias("name"))).alias("h"))
    return hit.select("src_id", F.col("h.member").alias("dst_id"), F.col("h.name").alias("name"), F.col("h.dst_id").alias("via"))


def without_existing(additions: DataFrame, found: DataFrame) -> DataFrame:
    return additions.join(found.select("src_id"), "src_id", "left_anti")

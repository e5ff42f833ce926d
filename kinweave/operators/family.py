"""Families of two aligned trees: structure score, thresholds, child score, assignment of children, validation, unmatched people."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Base thresholds by relation, and the steps by number of candidates.
BASE = {"Parent": 55, "Spouse": 55, "Child": 50, "Sibling": 60}
STRATEGY = {"adaptive": 0, "aggressive": -10, "conservative": 15}


def threshold(relation: Column, n: Column, strategy: str = "adaptive", fixed: int = 60) -> Column:
    """Least score by relation and number of candidates, between 30 and 85; `fixed` ignores both."""
    if strategy == "fixed":
        return F.lit(fixed)
    base = F.lit(100)
    for name, points in BASE.items():
        base = F.when(relation == name, points).otherwise(base)
    step = F.when(n == 1, -5).when(n == 2, 0).when(n.between(3, 4), 5).when(n.between(5, 8), 10).otherwise(15)
    return F.greatest(F.least(base + step + STRATEGY[strategy], F.lit(85)), F.lit(30))


def families(persons: DataFrame) -> DataFrame:
    """husband_id, wife_id and child_ids, a row for each pair of parents."""
    return persons.where("father_id is not null or mother_id is not null").groupBy(F.col("father_id").alias("husband_id"), F.col("mother_id").alias("wife_id")).agg(F.array_sort(F.collect_set("id")).alias("child_ids"))


def structure_scores(src: DataFrame, dst: DataFrame, mapping: DataFrame) -> DataFrame:
    """Families of both trees that share a mapped member: 50 for each mapped parent in place, 10 for each open one, 20 for each mapped child; conflicting ones are left out.

    mapping has src_id and dst_id. Families meet through mapped members only.
    """
    to = lambda c: F.element_at(F.col("m"), F.col(c))
    member = lambda df, p: df.select(F.struct("husband_id", "wife_id").alias(f"{p}f"), F.explode(F.concat(F.array("husband_id", "wife_id"), "child_ids")).alias(f"{p}_id")).where(f"{p}_id is not null")
    a, b = member(src, "src"), member(dst, "dst")
    met = a.join(mapping, "src_id").join(b, "dst_id").select("srcf", "dstf").distinct()
    own = a.join(mapping, "src_id").groupBy("srcf").agg(F.map_from_entries(F.collect_set(F.struct("src_id", "dst_id"))).alias("m"))
    f = src.select(F.struct("husband_id", "wife_id").alias("srcf"), F.col("child_ids").alias("kids")).join(own, "srcf")
    g = dst.select(F.struct("husband_id", "wife_id").alias("dstf"), F.col("child_ids").alias("dkids"))
    rows = met.join(f, "srcf").join(g, "dstf").select(F.col("srcf.husband_id").alias("sh"), F.col("srcf.wife_id").alias("sw"), F.col("dstf.husband_id").alias("dh"), F.col("dstf.wife_id").alias("dw"), "kids", "dkids", "m")
    slot = lambda s, d: F.when(F.col(s).isNull(), 0).when(F.coalesce(to(s) == F.col(d), F.lit(False)), 50).when(to(s).isNull() & F.col(d).isNotNull(), 10).otherwise(0)
    clash = lambda s, d: F.coalesce(F.col(s).isNotNull() & (to(s) != F.col(d)), F.lit(False))
    mapped = F.filter(F.transform("kids", lambda k: F.element_at(F.col("m"), k)), lambda x: x.isNotNull())
    rows = rows.withColumn("mk", mapped)
    inside = F.size(F.array_intersect("mk", "dkids"))
    conflict = clash("sh", "dh") | clash("sw", "dw") | (inside < F.size("mk"))
    return rows.where(~conflict).select("sh", "sw", "dh", "dw", (slot("sh", "dh") + slot("sw", "dw") + 20 * inside).alias("structure"))


def child_score(compare: Column, place_a: Column, place_b: Column, year_a: Column, year_b: Column, clash: Column) -> Column:
    """15 and 0.6 of the pair's score, with points for near places among the children and near birth years; 0 on a clash of genders."""
    gap, years = F.abs(place_a - place_b), F.abs(year_a - year_b)
    order = F.when(gap <= 1, 10).when(gap == 2, 5).otherwise(0)
    birth = F.when(years == 0, 15).when(years <= 2, 10).when(years <= 5, 5).otherwise(0)
    return F.when(clash, 0).otherwise(F.least(15 + F.floor(0.6 * compare).cast("int") + order + birth, F.lit(100)))


def assign(pairs: DataFrame, group: str = "family") -> DataFrame:
    """One-to-one assignment in each group by descending score; ties by src_id, dst_id. A group is the children of two families."""

    def greedy(block: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, rows = set(), set(), []
        for row in block.sort_values(["score", "src_id", "dst_id"], ascending=[False, True, True]).itertuples():
            if row.src_id not in used_a and row.dst_id not in used_b:
                used_a.add(row.src_id)
                used_b.add(row.dst_id)
                rows.append((getattr(row, group), row.src_id, row.dst_id, row.score))
        return pd.DataFrame(rows, columns=[group, "src_id", "dst_id", "score"])

    ship(pairs.sparkSession)
    return pairs.select(group, "src_id", "dst_id", F.col("score").cast("double").alias("score")).groupBy(group).applyInPandas(greedy, f"{group} long, src_id long, dst_id long, score double")


def validate(mapping: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """src_id, dst_id, issue and severity of each rule a mapping breaks (mapping: src_id, dst_id, score)."""
    s = src.select(F.col("id").alias("src_id"), F.lit(True).alias("s_known"), F.col("gender").alias("sg"), F.col("birth_year").alias("sy"))
    d = dst.select(F.col("id").alias("dst_id"), F.lit(True).alias("d_known"), F.col("gender").alias("dg"), F.col("birth_year").alias("dy"))
    repeated = mapping.groupBy("dst_id").agg(F.min("src_id").alias("first"))
    rows = mapping.join(s, "src_id", "left").join(d, "dst_id", "left").join(repeated, "dst_id")
    gap = F.abs(F.col("sy") - F.col("dy"))
    issue = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    rules = F.array(
        issue(F.col("s_known").isNull() | F.col("d_known").isNull(), "unknown_id", "High"),
        issue((F.col("sg") != "Unknown") & (F.col("dg") != "Unknown") & (F.col("sg") != F.col("dg")), "gender", "High"),
        issue(gap > 15, "birth_year", "High"), issue((gap > 5) & (gap <= 15), "birth_year", "Medium"),
        issue(F.col("src_id") != F.col("first"), "duplicate_destination", "High"), issue(F.col("score") < 40, "low_score", "Medium"),
    )
    return rows.select("src_id", "dst_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("e")).select("src_id", "dst_id", "e.*")


def broken_links(mapping: DataFrame, src_links: DataFrame, dst_links: DataFrame) -> DataFrame:
    """src_id, other and relation where both are mapped but their targets aren't so related (links: id, relation, other)."""
    other = mapping.select(F.col("src_id").alias("other"), F.col("dst_id").alias("other_dst"))
    rows = mapping.select(F.col("src_id").alias("id"), "dst_id").join(src_links, "id").join(other, "other")
    return rows.join(dst_links.select(F.col("id").alias("dst_id"), F.col("other").alias("other_dst"), "relation"), ["dst_id", "other_dst", "relation"], "left_anti").select(F.col("id").alias("src_id"), "other", "relation")


def unmatched(people: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    return people.join(mapping.select(F.col(column).alias("id")), "id", "left_anti").select("id")

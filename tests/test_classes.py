"""People who are alike are compared once, with the results of comparing all."""

import random

from pyspark.sql import functions as F

from kinweave.operators import blocking, compare, linkage

SCHEMA = "id long, first string, last string, gender string, birth_year int, father_id long, mother_id long"


def tree(spark, seed: int, gone: int):
    """Many people of few names; parents are among the first, and some of them are in the other tree alone."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Ivan", "Иван", "Peter"]) if i % 2 else "Maria", rng.choice(["Petrov", "Petrova"]), "Male" if i % 2 else "Female", rng.choice([1900, 1901, None]), rng.choice([1, 3, 5, 7, None]), rng.choice([2, 4, 6])) for i in range(1, 61)]
    return spark.createDataFrame([r for r in rows if r[0] != gone], SCHEMA)


def test_classes_give_the_results_of_all_pairs(spark):
    src, dst = tree(spark, 1, 3), tree(spark, 2, 4)
    every = [(r["src_id"], r["dst_id"], r["score"]) for r in linkage.scored_pairs(src, dst, None, 60).collect()]
    scored, _, members = linkage.scored_classes(src, dst, 60)
    assert members.count() == 59 and 0 < scored.count() < len(every) * 0.9
    of = {}
    for s, d, x in every:
        of.setdefault(s, []).append((-x, d))
    counts = {r["src_id"]: (r["n_pairs"], round(r["best"], 9)) for r in linkage.found_counts(src, dst, 60).collect()}
    assert counts == {s: (len(v), round(-min(v)[0], 9)) for s, v in of.items()}
    top = {(r["src_id"], r["rank"]): r["dst_id"] for r in linkage.found_top(src, dst, 60, 3, 6).collect()}
    assert top == {(s, k): d for s, v in of.items() for k, (_, d) in enumerate(sorted((round(x, 6), d) for x, d in v)[:3], 1)}
    best = {r["src_id"]: r["dst_id"] for r in linkage.best_matches(src, dst, 60).collect()}
    assert best == {s: d for (s, k), d in top.items() if k == 1}


def test_copies_are_compared_once(spark):
    many = spark.range(1, 41).select("id", F.lit("Ivan").alias("first"), F.lit("Petrov").alias("last"), F.lit("Male").alias("gender"), F.lit(1900).alias("birth_year"))
    scored, members, _ = linkage.scored_classes(many, many, 60)
    assert scored.count() == 1 and members.count() == 40
    assert {tuple(r) for r in linkage.found_counts(many, many, 60).select("src_id", "n_pairs").collect()} == {(i, 40) for i in range(1, 41)}


def test_bonuses_count_only_where_both_sides_can_have_them(spark):
    people = compare.people(tree(spark, 1, 3)).withColumns(compare.bonuses())
    pairs = compare.paired(blocking.all_pairs(people, people), people, people)
    rows = compare.own_fields(pairs).withColumn("most", compare.most_possible())
    found = compare.scored(compare.with_families(rows)).join(rows.select(F.col("s_id").alias("src_id"), F.col("d_id").alias("dst_id"), "most"), ["src_id", "dst_id"])
    assert found.where(F.col("score") > F.col("most") + 1e-9).count() == 0
    assert rows.where("most > 110").count() == 0

"""Every pair that scores enough is found, whether it shares a block or not, and people aren't sent whole to the executors."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking, compare, linkage
from kinweave.scratch import Scratch

SCHEMA = "id long, first string, last string, maiden string, gender string, birth_year int, birth_month int, birth_place string, father_id long, mother_id long, spouse_ids array<long>, child_ids array<long>"


def tree(spark, seed: int, gone: set[int]):
    """Names, years, places and relatives may lack; some relatives are in the other tree alone, or in none."""
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for i in range(1, 71):
        first = pick("Ivan", "Иван", "John", "Peter", "Pyotr", None) if i % 2 else pick("Maria", "Marina", "Anna", "Hanna", None)
        year = pick(1900, 1901, 1904, 1912, None)
        kin = [pick(1, 3, 5, 101, None), pick(2, 4, 6, 102, None), [pick(7, 8, 9)] if rng.random() < 0.2 else [], [pick(11, 12)] if rng.random() < 0.3 else []]
        rows.append((i, first, pick("Petrov", "Petrova", "Sidorov", "Chaikovskiy", "Чайковский", None), pick("Smith", "Smit", None, None), pick("Unknown", None, "Male" if i % 2 else "Female", "Male" if i % 2 else "Female"), year, pick(5, 6, None) if year else None, pick("Kyiv", "Kyiv, Ukraine", None, None), *kin))
    return spark.createDataFrame([r for r in rows if r[0] not in gone], SCHEMA)


@pytest.mark.parametrize("least", [45, 97])
def test_all_pairs_that_score_enough_are_found(spark, least):
    src, dst = tree(spark, 1, {3, 4, 9}), tree(spark, 2, {5, 8})
    pairs = blocking.all_pairs(compare.people(src), compare.people(dst))
    every = {(r["src_id"], r["dst_id"]): r["score"] for r in linkage.scored_pairs(src, dst, pairs, least).collect()}
    scored, src_members, dst_members = linkage.scored_classes(src, dst, least)
    whole = scored.join(src_members.toDF("a", "src_id"), "src_id").join(dst_members.toDF("b", "dst_id"), "dst_id").select("a", "b", "score").collect()
    assert len(whole) == len(every) > 0 and {(r["a"], r["b"]): r["score"] for r in whole} == pytest.approx(every)
    want = {}
    for (s, d), x in every.items():
        want[s] = min(want.get(s, (0, 0)), (-round(x, 6), d))
    assert {r["src_id"]: (-r["score"], r["dst_id"]) for r in linkage.best_matches(src, dst, least).collect()} == want


def test_people_are_not_sent_whole(spark):
    """A written table is much smaller than its rows in memory, so that Spark would take it for small and gather it in the driver."""
    scratch = Scratch(spark, "sent")
    people = scratch.keep(compare.people(tree(spark, 1, set())).withColumn("first_key", compare.first_key()))
    pairs = spark.range(1, 40).select(F.col("id").alias("src_id"), (F.col("id") + 1).alias("dst_id"))
    rows = compare.paired(pairs, people, people)
    for df in (compare.people(scratch.keep(tree(spark, 1, set()))), rows, compare.first_sims(rows, people, people)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def apart(spark):
    """A pair of children who score 100 though no key of theirs is shared: parents and surnames differ in their first letters."""
    one = lambda last, father: [(1, father, "Petrov", "Male", 1870, None, None), (2, "Maria", "Petrova", "Female", 1872, None, None), (3, "Anna", last, "Female", 1900, 1, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, first string, last string, gender string, birth_year int, father_id long, mother_id long")
    src, dst = frame(one("Petrov", "Ivan")), frame(one("Betrov", "Yvan"))
    met = blocking.candidates(compare.people(src), compare.people(dst)).where("src_id = '3' AND dst_id = '3'")
    assert met.count() == 0
    return src, dst


def test_best_match_shares_no_block(apart):
    assert [tuple(r) for r in linkage.best_matches(*apart, 80).collect()] == [(3, 3, 100.0)]


def test_counts_have_pairs_that_share_no_block(apart):
    assert [tuple(r) for r in linkage.found_counts(*apart, 97).collect()] == [(3, 1, 100.0)]


def test_top_has_pairs_that_share_no_block(apart):
    assert [tuple(r) for r in linkage.found_top(*apart, 97, 3, 6).collect()] == [(3, 1, 3, 100.0)]

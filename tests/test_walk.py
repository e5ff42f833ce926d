"""The walk of two trees by rounds over families against the queue that defines it."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import compare, wave

PERSON = "walk long, id long, gender string, birth_year int, father_id long, mother_id long"


def _random_walk(rng: random.Random, base: int, size: int) -> tuple[list, list, list, list]:
    """A tree with remarriages, cousins who marry, lone parents and parents who are missing, another one like it, scores of pairs and some anchors."""
    rows = []
    for i in range(size):
        father, mother = (rng.randrange(max(0, i - 12), i) if i > 2 and rng.random() < p else None for p in (0.75, 0.65))
        if rows and rng.random() < 0.5:
            father, mother = rows[-1][3:]
        rows.append((i, rng.choice(["Male", "Female", "Unknown"]), rng.choice([None, 1900 + i, 1901 + i]), father, mother))
    there = [r for r in rows if rng.random() < 0.9]
    near = lambda x: x if x is None or rng.random() < 0.9 else max(0, x - rng.randrange(3))
    other = [(i, g if rng.random() < 0.9 else "Unknown", y, near(f), near(m)) for i, g, y, f, m in there]
    scores = [(i, j, float(rng.randrange(100))) for i in range(size) for j in range(size) if i == j or (abs(i - j) < 9 and rng.random() < 0.7)]
    anchors = [(a, a if rng.random() < 0.8 else rng.randrange(size)) for a in rng.sample(range(size), 3)]
    shift = lambda row, *at: tuple(v + base if k in at and v is not None else v for k, v in enumerate(row))
    return [shift(r, 0, 3, 4) for r in rows if rng.random() < 0.97], [shift(r, 0, 3, 4) for r in other], [shift(r, 0, 1) for r in scores], sorted(shift(r, 0, 1) for r in anchors)


def test_rounds_over_families_have_the_result_of_the_queue(spark):
    rng = random.Random(5)
    walks = {w: _random_walk(rng, 1000 * w, 40) for w in range(40)}
    frame = lambda k, schema: spark.createDataFrame([(w, *r) for w, x in walks.items() for r in x[k]], schema)
    src, dst, anchors = frame(0, PERSON), frame(1, PERSON), frame(3, "walk long, src_id long, dst_id long")
    got = wave.align(src, dst, frame(2, "walk long, src_id long, dst_id long, score double"), anchors).collect()
    want = set()
    for w, (s, d, scores, start) in walks.items():
        known = {x[:2]: x[2] for x in scores}
        want |= {(w, *r) for r in wave.walk(s, d, lambda a, b: known.get((a, b), 0.0), start)}  # noqa: B023
    assert len(want) > 300 and len(got) == len(want) and {tuple(r) for r in got} == want


def test_the_walk_takes_no_tree_into_one_task(spark, monkeypatch):
    """Each row that crosses to Python is one family, whatever the tree's size."""
    monkeypatch.setattr(wave, "TOGETHER", 1)
    monkeypatch.setattr(wave, "MANY", 2)
    chain = [(i, "Unknown", 1000 + 25 * (i // 3), *((3 * (i // 3) - 3, 3 * (i // 3) - 2) if i >= 3 else (None, None))) for i in range(24)]
    people = spark.createDataFrame(chain, PERSON.split(", ", 1)[1]).withColumns({"first": F.concat(F.lit("Name"), F.col("id").cast("string")), "last": F.lit("Petrov")})
    plans = []
    inner = wave._round
    monkeypatch.setattr(wave, "_round", lambda *a: plans.append(inner(*a)) or plans[-1])
    anchors = spark.createDataFrame([(0, 0)], "src_id long, dst_id long")
    got = {tuple(r) for r in wave.align(people, people, None, anchors).collect()}
    who = {int(r["id"]): r.asDict(recursive=True) for r in compare.people(people).collect()}
    scorer = compare.Scorer()
    assert got == set(wave.walk(chain, chain, lambda a, b: scorer(who[a], who[b]), [(0, 0)])) and len(got) == 23
    assert len(plans) == 7 and all(found.where("id is not null").groupBy("fam").count().agg(F.max("count")).first()[0] <= 5 for found, _ in plans)


@pytest.mark.parametrize("anchor", [(0, 7), (9, 0)])
def test_an_anchor_outside_of_a_tree_maps_nobody(spark, anchor):
    people = spark.createDataFrame([(0, "Male", 1900, None, None), (1, "Male", 1930, 0, None)], PERSON.split(", ", 1)[1])
    assert wave.align(people, people, None, spark.createDataFrame([anchor], "src_id long, dst_id long")).collect() == []

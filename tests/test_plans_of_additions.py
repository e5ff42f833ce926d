"""Branch plans against the queue, choice of unions, photo hashes."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from kinweave.operators import branch, photohash, unions

PEOPLE = "id long, father_id long, mother_id long, spouse_ids array<long>, child_ids array<long>"


def queue_plan(people, start, created, max_depth):
    """The plan as a queue makes it, one person at a time."""
    there, visited, out = list(created), {*created, start}, []
    queue = deque([(start, 0)])
    while queue:
        i, depth = queue.popleft()
        if depth > max_depth or i not in people:
            continue
        father, mother, spouses, kids = people[i]
        ties = [(s, "Partner") for s in spouses] + [(c, "Parent") for c in kids] + [(p, "Child") for p in (father, mother) if p is not None]
        tie = next((t for t in ties if t[0] in there), None)
        out.append((depth, i, *(tie or (None, None))))
        if tie is None:
            continue
        there.append(i)

        def push(x, depth=depth):
            if x is None or x in visited:
                return False
            visited.add(x)
            queue.append((x, depth + 1))
            return True

        for s in spouses:
            push(s)
        dad, mum = push(father), push(mother)
        if dad and not mum and father in people:
            for s in people[father][2]:
                push(s)
        for c in kids:
            push(c)
    return out


def random_tree(seed, n=40):
    rng = random.Random(seed)
    parents = {i: (rng.choice([None, rng.randrange(i)]), rng.choice([None, rng.randrange(i)])) if i else (None, None) for i in range(n)}
    spouses, kids = {i: [] for i in range(n)}, {i: [] for i in range(n)}
    for i, (f, m) in parents.items():
        for p in {f, m} - {None}:
            kids[p].append(i)
        if f is not None and m is not None and f != m and m not in spouses[f]:
            spouses[f].append(m)
            if rng.random() < 0.9:
                spouses[m].append(f)
    if rng.random() < 0.5:
        spouses[n - 1].append(n + 5)  # unknown
    return {i: (*parents[i], spouses[i], kids[i]) for i in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_branch_plan_equals_the_queue(spark, seed):
    people = random_tree(seed)
    frame = spark.createDataFrame([(i, *p) for i, p in people.items()], PEOPLE)
    anchor = 12
    start = next(x for x in (*people[anchor][2], *people[anchor][3], people[anchor][0], people[anchor][1], 3) if x is not None)
    rows = branch.branch_plan(frame, start, [anchor], 3).orderBy("depth", "path").collect()
    assert [(r["depth"], r["src_id"], r["related_id"], r["relation"]) for r in rows] == queue_plan(people, start, [anchor], 3)


def test_start_without_a_relative_is_passed_over(spark):
    frame = spark.createDataFrame([(1, None, None, [2], []), (2, None, None, [1], []), (3, None, None, [], [])], PEOPLE)
    assert [tuple(r) for r in branch.branch_plan(frame, 1, [3], 5).select("depth", "src_id", "related_id").collect()] == [(0, 1, None)]
    assert branch.branch_plan(frame, 9, [3], 5).count() == 0


def test_repair_frontier(spark):
    rows = spark.createDataFrame([("u1", 1), ("u1", 2), ("u1", 3), ("u2", 3), ("u2", 4), ("u3", 4), ("u3", 5), ("u4", 2), ("u4", 6), ("u1", None)], "union_id string, id long")
    assert {tuple(r) for r in branch.repair_frontier(rows, 1, 2).collect()} == {(0, 1), (1, 2), (1, 3), (2, 4), (2, 6)}
    assert {tuple(r) for r in branch.repair_frontier(rows, 1, 5, done=[3]).collect()} == {(0, 1), (1, 2), (2, 6)}


def test_unions(spark):
    held = spark.createDataFrame(
        [("u1", "ex_spouse", ["profile-g1", "g2"], ["5"], 0), ("u2", None, ["https://x/api/profile-2", "1"], [], 1), ("u3", "Ex_Spouse", ["3", "4"], ["7"], 2), ("u4", "ex_spouse", ["4", "3", None], [], 3), ("u5", "spouse", ["6"], ["8", "9"], 4), ("u6", None, None, None, 5)],
        "union_id string, status string, partners array<string>, children array<string>, pos int",
    )
    parents = spark.createDataFrame([(1, "1", "2"), (2, "g3", "4"), (3, "1", "3"), (4, "1", None), (5, "1", "g1")], "id long, father_profile string, mother_profile string")
    got = {r["id"]: (r["union_id"], r["n_unions"], r["is_ex"]) for r in unions.for_children(held, parents).collect()}
    assert got == {1: ("u2", 2, False), 2: ("u3", 2, True), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None)}
    partners = spark.createDataFrame([(1, "g6", ["9", "5"]), (2, "1", ["5"]), (3, "6", [])], "id long, related_profile string, children array<string>")
    assert {r["id"]: r["union_id"] for r in unions.for_partners(held, partners).collect()} == {1: "u5", 2: None, 3: None}


def test_mean_hash_and_signature(spark):
    rng = random.Random(1)
    rows = [[rng.randrange(256) for _ in range(64)] for _ in range(20)] + [[7] * 64, [255] + [0] * 63, [0] * 63 + [1], [1] * 63, None, [1.0] * 63 + [None]]
    frame = spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in enumerate(rows)], "i int, px array<double>")
    out = frame.select("i", photohash.mean_hash(F.col("px")).alias("h")).withColumn("s", photohash.signature(F.lit("SHA256:AB"), F.col("h"))).withColumn("back", photohash.from_signature(F.col("s")))
    for r in out.collect():
        x = rows[r["i"]]
        if x is None or len(x) != 64 or None in x:
            assert r["h"] is None and r["s"] == "sha256:ab" and r["back"] is None
            continue
        want = sum((v > sum(x) / 64) << (63 - i) for i, v in enumerate(x))
        assert r["h"] % (1 << 64) == want and r["s"] == f"phash:0x{want:016x}" and r["back"] == r["h"]


def test_near_images_equal_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    for h in list(base):
        for _ in range(3):
            x = h
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                x ^= 1 << b
            base.append(x)
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(base)] + [(900, None)]
    got = {(r["id"], r["other"]): r["similarity"] for r in photohash.near_images(spark.createDataFrame(rows, "id long, hash long")).collect()}
    want = {(i, j): 1 - n / 64 for i, a in enumerate(base) for j, b in enumerate(base[i + 1 :], i + 1) if (n := (a ^ b).bit_count()) <= 3}
    assert got == want


def test_matches_are_kept_both_ways(spark):
    schema = "id long, other long, similarity double"
    store = spark.createDataFrame([(1, 2, 0.96), (2, 1, 0.96), (3, 4, 1.0), (4, 3, 1.0)], schema)
    out = photohash.update_matches(store, spark.createDataFrame([(2, 1, 0.98), (5, 6, 1.0)], schema))
    assert {tuple(r) for r in out.collect()} == {(1, 2, 0.98), (2, 1, 0.98), (3, 4, 1.0), (4, 3, 1.0), (5, 6, 1.0), (6, 5, 1.0)}
    index = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2)], "url string, hash long, content_sha256 string, cached_at int")
    assert [tuple(r) for r in photohash.cached(spark.createDataFrame([("a",), ("b",)], "url string"), index).orderBy("url").collect()] == [("a", 2, "y", True), ("b", None, None, False)]

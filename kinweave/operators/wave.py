"""Tree alignment from an anchor, level by level over families.

The order of visits decides who is mapped, as in a queue. It takes the whole score of the members of two families when it meets them, or scores that are given. `walk` is the queue itself,
for trees at hand; `align` has the same result for trees of any size. There all visits of a level are known at once, each with its place in the order, a path. A visit reads and writes
members of its own family and of its counterparts alone, and who is mapped, passed over or taken stays so. So visits to families that share nobody who is still open don't depend on each
other and run at once, a row for each family; visits to families that do share run by their paths, in rounds. Many walks run side by side.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..shipping import ship
from . import compare

SPOUSE, CHILD = 50, {1: 45, 2: 50, 3: 55, 4: 55, 5: 60, 6: 60, 7: 60, 8: 60}


class Tree:
    def __init__(self, rows: list[tuple]):
        """rows: (id, gender, birth_year, father_id, mother_id)."""
        self.person = {r[0]: (r[1], r[2]) for r in rows}
        self.family: dict[tuple, list] = {}
        for i, _, _, f, m in sorted(rows, key=lambda r: r[0]):
            if f is not None or m is not None:
                self.family.setdefault((f, m), []).append(i)
        self.as_spouse: dict = {}
        self.as_child: dict = {}
        for key in sorted(self.family, key=str):
            for x in key:
                if x in self.person:
                    self.as_spouse.setdefault(x, []).append(key)
            for c in self.family[key]:
                self.as_child.setdefault(c, []).append(key)

    @classmethod
    def of(cls, families: dict[tuple, list[dict]]) -> Tree:
        """Some families alone. A member: id, kid (whether it is one of the children) and who."""
        out = cls([])
        for key, rows in families.items():
            out.person |= {r["id"]: (r["who"]["gender"], r["who"]["birth_year"]) for r in rows}
            out.family[key] = sorted(r["id"] for r in rows if r["kid"])
        return out

    def members(self, key: tuple) -> list:
        return [x for x in key if x in self.person] + self.family[key]


def _candidate(f, g, a: Tree, b: Tree, mapped: dict, score) -> int | None:
    """Score of two families as counterparts; null on a conflict."""
    total, open_ = 0, []
    for s, d in zip(f, g, strict=True):
        s, d = (s if s in a.person else None), (d if d in b.person else None)
        if s is None:
            continue
        if s in mapped:
            if mapped[s] == d:
                total += 50
            elif d is not None:
                return None
        elif d is not None:
            total += 10
            open_.append(int(score(s, d)))
    kids = [mapped[c] for c in a.family[f] if c in mapped]
    if any(k not in b.family[g] for k in kids):
        return None
    total += 20 * len(kids)
    if len(open_) == 2:
        return int(0.4 * total + 0.3 * open_[0] + 0.3 * open_[1])
    return int(0.4 * total + 0.6 * open_[0]) if open_ else total


def _propose(f, g, a: Tree, b: Tree, mapped: dict, taken: set, score) -> list[tuple]:
    out = []
    for s, d in zip(f, g, strict=True):
        if s in a.person and d in b.person and s not in mapped and score(s, d) >= SPOUSE:
            out.append((s, d, int(score(s, d)), "Spouse"))
    kids_a, kids_b = [c for c in a.family[f] if c not in mapped], [c for c in b.family[g] if c not in taken]
    least = CHILD.get(min(len(kids_a), len(kids_b)), 65)
    grid = []
    for i, s in enumerate(kids_a):
        for j, d in enumerate(kids_b):
            (gs, ys), (gd, yd) = a.person[s], b.person[d]
            if gs != "Unknown" and gd != "Unknown" and gs != gd:
                continue
            order = 10 if abs(i - j) <= 1 else 5 if abs(i - j) == 2 else 0
            gap = abs(ys - yd) if ys is not None and yd is not None else 99
            points = min(100, 15 + int(0.6 * score(s, d)) + order + (15 if gap == 0 else 10 if gap <= 2 else 5 if gap <= 5 else 0))
            if points >= least:
                grid.append((-points, i, j, s, d))
    used: set = set()
    for points, _, _, s, d in sorted(grid):
        if s not in used and ("d", d) not in used:
            used |= {s, ("d", d)}
            out.append((s, d, -points, "Child"))
    return out


def _valid(s, d, a: Tree, b: Tree, taken: set) -> bool:
    (gs, ys), (gd, yd) = a.person[s], b.person[d]
    clash = gs != "Unknown" and gd != "Unknown" and gs != gd
    far = ys is not None and yd is not None and abs(ys - yd) > 15
    return not clash and not far and d not in taken


def _visit(f, options: list, a: Tree, b: Tree, mapped: dict, taken: set, processed: set, score) -> list[tuple] | None:
    """(src_id, dst_id, score, found_via) that a visit to family f adds, whose visitor's target has the families `options`; none without a counterpart.

    Who of f isn't mapped then is passed over for good, as the visitor is a mapped member of f. mapped, taken and processed change in place.
    """
    found = [(t, g) for g in options if (t := _candidate(f, g, a, b, mapped, score)) is not None]
    best = max(found, key=lambda x: x[0], default=(0, None))
    if best[0] <= 0:
        return None
    rows = []
    for m, d, points, via in _propose(f, best[1], a, b, mapped, taken, score):
        if m not in processed and _valid(m, d, a, b, taken):
            mapped[m] = d
            taken.add(d)
            processed.add(m)
            rows.append((m, d, points, via))
    processed.update(a.members(f))
    return rows


def walk(src: list[tuple], dst: list[tuple], score, anchors: list[tuple]) -> list[tuple]:
    """(src_id, dst_id, score, level, found_via) in order of discovery; score gives the points of two ids."""
    a, b = Tree(src), Tree(dst)
    mapped, rows = {}, []
    for s, d in anchors:
        if s in a.person and d in b.person:
            mapped[s] = d
            rows.append((s, d, 100, 0, "Anchor"))
    queue, processed, taken = deque((s, 0) for s in mapped), set(mapped), set(mapped.values())
    while queue:
        s, level = queue.popleft()
        for kind in ("as_spouse", "as_child"):
            for f in getattr(a, kind).get(s, []):
                for m, d, points, via in _visit(f, getattr(b, kind).get(mapped[s], []), a, b, mapped, taken, processed, score) or ():
                    rows.append((m, d, points, level + 1, via))
                    queue.append((m, level + 1))
    return rows


#: What a walk knows of a person.
PERSON = ("norm_first", "norm_last", "norm_maiden", "gender", *compare.YEARS, *compare.TOKENS, "kin")


#: Place of a kind of visit, of a family and of a new pair, in one number of a path.
KIND, FAMILY = 1 << 61, 1 << 31
#: Families that cross to Python objects together.
TOGETHER = 256
#: Tables of a walk's state that are read side by side before they become one.
MANY = 16
FOUND = "walk string, fam string, id long, target long, points int, via string, path array<long>"


def _family(text: str) -> tuple:
    return tuple(None if x == "None" else int(x) for x in text[1:-1].split(", "))


def _visits(given: bool):
    """A row for each family to its FOUND rows: new pairs, those passed over (no target), and one without id where the family is done."""

    def one(row: dict, scorer: compare.Scorer) -> list[tuple]:
        f, options = _family(row["fam"]), {}
        for r in [*row["members"], *row["targets"]]:
            r["who"] = json.loads(r["who"])
        for r in row["targets"]:
            options.setdefault(_family(r["g"]), []).append(r)
        a, b = Tree.of({f: row["members"]}), Tree.of(options)
        mapped = {r["id"]: r["target"] for r in row["members"] if r["target"] is not None}
        processed, taken = {r["id"] for r in row["members"] if r["done"]}, {r["id"] for r in row["targets"] if r["taken"]}
        known = {(r["id"], r["other"]): r["points"] for r in row["scores"]} if given else {}
        who = {r["id"]: r["who"] for r in row["members"]}, {r["id"]: r["who"] for r in row["targets"]}

        def score(s, d) -> float:
            if (s, d) not in known:
                known[s, d] = 0.0 if given else scorer(who[0][s], who[1][d])
            return known[s, d]

        before, out = set(processed), []
        for visit in sorted(row["visits"], key=lambda v: v["path"]):
            new = _visit(f, [_family(g) for g in visit["gs"]], a, b, mapped, taken, processed, score)
            if new is not None:
                path = visit["path"]
                out += [(m, d, points, via, [*path[:-1], path[-1] + n]) for n, (m, d, points, via) in enumerate(new)]
                out += [(m, None, None, None, None) for m in processed - before - {r[0] for r in new}]
                out.append((None, None, None, None, None))
                break  # all of the family are done
        return [(row["walk"], row["fam"], *r) for r in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
        names, scorer = [c.split()[0] for c in FOUND.split(", ")], compare.Scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = [x for row in batch.slice(at, TOGETHER).to_pylist() for x in one(row, scorer)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _tree(df: DataFrame, walk: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """walk and id of all; walk, fam, id, kid and who (JSON) of families' members; walk, id, kind (0: parent, 1: child), fam and at (place among the person's families) of those."""
    df = scratch.keep(df, "tree")
    ids = [F.col(c).cast("long").alias(c) for c in ("id", "father_id", "mother_id")]
    who = compare.people(df).select(F.col("id").cast("long").alias("id"), F.to_json(F.struct(*PERSON), {"ignoreNullFields": "false"}).alias("who"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    fam = F.when(F.col("father_id").isNotNull() | F.col("mother_id").isNotNull(), F.concat(F.lit("("), text("father_id"), F.lit(", "), text("mother_id"), F.lit(")")))
    people = scratch.keep(df.select(walk.alias("walk"), *ids).join(who, "id").dropDuplicates(["walk", "id"]).withColumn("fam", fam), "people")
    kids = people.where("fam is not null")
    parents = kids.select("walk", "fam", F.explode(F.array_distinct(F.array("father_id", "mother_id"))).alias("id")).where("id is not null").distinct().join(people.select("walk", "id", "who"), ["walk", "id"])
    members = scratch.keep(kids.select("walk", "fam", "id", F.lit(True).alias("kid"), "who").unionByName(parents.select("walk", "fam", "id", F.lit(False).alias("kid"), "who")), "members")
    place = F.row_number().over(Window.partitionBy("walk", "id", "kid").orderBy("fam")) - 1
    visits = scratch.keep(members.select("walk", "id", F.col("kid").cast("int").alias("kind"), "fam", place.alias("at")), "visits")
    return people.select("walk", "id"), members, visits


def _waits(touch: DataFrame, scratch: Scratch) -> DataFrame | None:
    """walk, fam and bound: the path of the first visit to another family that shares somebody open; none if no families share. touch: walk, side, id, fam and path, once for each fam."""
    who = ["walk", "side", "id"]
    hot = scratch.keep(touch.groupBy(*who).agg(F.min(F.struct("path", "fam")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "hot")
    if hot.isEmpty():
        return None
    rows = touch.join(hot, who)
    others = rows.where(F.col("fam") != F.col("first.fam"))
    second = others.groupBy(*who).agg(F.min("path").alias("bound"))
    firsts = hot.select(*who, F.col("first.fam").alias("fam")).join(second, who)
    both = others.select("walk", "fam", F.col("first.path").alias("bound")).unionByName(firsts.select("walk", "fam", "bound"))
    return both.groupBy("walk", "fam").agg(F.min("bound").alias("bound"))


def _round(visits: DataFrame, trees: tuple, state: DataFrame, scores: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """FOUND of all visits (walk, fam, path, gs) that wait for no other, and the visits left over."""
    (_, src, _), (_, dst, _) = trees
    key = ["walk", "fam"]
    done = state.where("id is not null").select("walk", "id", "target", F.lit(True).alias("done"))
    taken = state.where("target is not null").select("walk", F.col("target").alias("id"), F.lit(True).alias("taken")).distinct()
    first = visits.groupBy(*key).agg(F.min("path").alias("path"))
    members = src.join(first, key).join(done, ["walk", "id"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    members = scratch.keep(members, "active")
    pairs = visits.select(*key, "path", F.explode("gs").alias("g")).groupBy(*key, "g").agg(F.min("path").alias("path"))
    targets = pairs.join(dst.withColumnRenamed("fam", "g"), ["walk", "g"]).join(taken, ["walk", "id"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    targets = scratch.keep(targets, "targets")
    open_ = members.where("not done")
    touch = open_.select(*key, F.lit("s").alias("side"), "id", "path").unionByName(targets.where("not taken").select(*key, F.lit("d").alias("side"), "id", "path").join(open_.select(*key).distinct(), key, "left_semi"))
    waits = _waits(touch.groupBy(*key, "side", "id").agg(F.min("path").alias("path")), scratch)
    ready, left = visits.join(open_.select(*key).distinct(), key, "left_semi"), None
    if waits is not None:
        held = ready.join(waits, key, "left").withColumn("ready", F.coalesce(F.col("path") < F.col("bound"), F.lit(True)))
        held = scratch.keep(held, "held")
        ready, left = held.where("ready"), held.where("not ready").drop("ready", "bound")
    rows = ready.groupBy(*key).agg(F.collect_list(F.struct("path", "gs")).alias("visits"))
    rows = rows.join(members.groupBy(*key).agg(F.collect_list(F.struct("id", "kid", "target", "done", "who")).alias("members")), key)
    rows = rows.join(targets.groupBy(*key).agg(F.collect_list(F.struct("g", "id", "kid", "taken", "who")).alias("targets")), key)
    if scores is not None:
        met = members.select(*key, "id").distinct().join(scores, ["walk", "id"]).join(targets.select(*key, F.col("id").alias("other")).distinct(), [*key, "other"])
        rows = rows.join(met.groupBy(*key).agg(F.collect_list(F.struct("id", "other", "points")).alias("scores")), key, "left").withColumn("scores", F.coalesce("scores", F.array()))
    found = scratch.keep(rows.mapInArrow(_visits(scores is not None), FOUND), "found")
    return found, left


def align(src: DataFrame, dst: DataFrame, scores: DataFrame | None, anchors: DataFrame) -> DataFrame:
    """src_id, dst_id, score, level and found_via of every walk. src, dst: the columns of compare.people(), those that are there; scores and anchors: src_id, dst_id (and score).

    Where src, dst, anchors (and scores) all have a column walk, each of its values is a pair of trees by itself; else all is one walk. Without scores the walk takes the whole score of
    each pair that it asks for. Levels are written to the shared folder; a level is some joins and, where families share somebody, further rounds.
    """
    spark = ship(src.sparkSession)
    scratch = Scratch(spark, "walk")
    by_walk = all("walk" in x.columns for x in (src, dst, anchors, *([] if scores is None else [scores])))
    which = F.coalesce(F.col("walk").cast("long").cast("string"), F.lit("")) if by_walk else F.lit("0")
    link = lambda df, *more: df.select(which.alias("walk"), F.col("src_id").cast("long").alias("id"), F.col("dst_id").cast("long").alias("other"), *more)
    trees = _tree(src, which, scratch), _tree(dst, which, scratch)
    points = None if scores is None else scratch.keep(link(scores, F.col("score").cast("double").alias("points")), "scores")
    start = link(anchors).join(trees[0][0], ["walk", "id"], "left_semi").join(trees[1][0].withColumnRenamed("id", "other"), ["walk", "other"], "left_semi")
    start = scratch.keep(start, "start")
    items = start.groupBy("walk", "id").agg(F.max("other").alias("target")).withColumn("path", F.array("id"))
    state = [scratch.keep(items.select("walk", F.lit(None).cast("string").alias("fam"), "id", "target"), "state")]
    out = [start.select("walk", F.col("id").alias("src_id"), F.col("other").alias("dst_id"), F.lit(100).alias("score"), F.lit(0).alias("level"), F.lit("Anchor").alias("found_via"))]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    options = trees[1][2].groupBy("walk", F.col("id").alias("target"), "kind").agg(F.array_sort(F.collect_list("fam")).alias("gs"))
    options = scratch.keep(options, "options")
    level = 0
    while not items.isEmpty():
        level += 1
        path = F.concat("path", F.array(F.col("kind") * F.lit(KIND) + F.col("at") * F.lit(FAMILY)))
        closed = union(state).where("fam is not null and id is null").select("walk", "fam")
        visits = items.join(trees[0][2], ["walk", "id"]).join(options, ["walk", "target", "kind"]).select("walk", "fam", path.alias("path"), "gs").join(closed, ["walk", "fam"], "left_anti")
        visits, news = scratch.keep(visits, "turn"), []
        while visits is not None and not visits.isEmpty():
            found, visits = _round(visits, trees, union(state), points, scratch)
            state.append(found.select("walk", "fam", "id", "target"))
            news.append(found.where("target is not null"))
        if not news:
            break
        new = union(news)
        items = new.select("walk", "id", "target", "path")
        out.append(new.select("walk", F.col("id").alias("src_id"), F.col("target").alias("dst_id"), F.col("points").alias("score"), F.lit(level).alias("level"), F.col("via").alias("found_via")))
        if len(state) > MANY:
            state = [scratch.keep(union(state), "state")]
    found = union(out)
    return found.withColumn("walk", F.nullif("walk", F.lit("")).cast("long")) if by_walk else found.drop("walk")

"""The whole score of a pair of people: names, maiden names, dates, places, gender and relatives.

A person has id, first, middle, nickname, variants (array), last, maiden, gender, birth_year, birth_month, birth_day, death_year, death_month,
death_day, birth_place, father_id, mother_id, spouse_ids, child_ids, sibling_ids (arrays); columns that are absent count as null.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, names, similarity, variants
from ..scratch import Scratch
from ..shipping import ship

#: Points of a field that agrees fully; shares of a family by kind of relative.
WEIGHTS = {"first": 25, "last": 20, "birth": 15, "place": 10, "death": 3, "gender": 2, "family": 25}
MAIDEN_SHARE = 0.3
KIN = {"father": 0.4, "mother": 0.4, "spouse": 0.3, "child": 0.2, "sibling": 0.1}
SAME = 0.8
TEXTS = ("first", "middle", "nickname", "last", "maiden", "gender", "birth_place", "father_id", "mother_id")
LISTS = ("variants", "spouse_ids", "child_ids", "sibling_ids")
FIELDS = ("first", "last", "maiden", "birth", "place", "death")
YEARS = tuple(f"{event}_{part}" for event in ("birth", "death") for part in ("year", "month", "day"))


def people(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """df with every column of a person, normalised names and kin: kind, other, first and last of its relatives, in order.

    Relatives' names come from `known`, by default df itself; a relative it lacks has no name. A person's relatives are few, so they fit in a row.
    """
    none = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    blank = lambda c: F.nullif(F.trim(none(c, "string")), F.lit(""))
    rows = df.select(F.col("id").cast("string").alias("id"), *[blank(c).alias(c) for c in TEXTS], *[F.coalesce(none(c, "array<string>"), F.array()).alias(c) for c in LISTS], *[none(c, "int").alias(c) for c in YEARS])
    rows = rows.withColumns({"norm_first": normal(F.col("first")), "norm_last": normal(F.col("last")), "norm_maiden": names.comparison_form(F.col("maiden")), "gender": F.coalesce("gender", F.lit("Unknown"))})
    named = rows if known is None else people_names(known)
    one = lambda kind: F.when(F.col(f"{kind}_id").isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("other")))).otherwise(F.array())
    many = lambda kind: F.transform(F.col(f"{kind}_ids"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("other")))
    links = rows.select("id", F.posexplode(F.concat(one("father"), one("mother"), many("spouse"), many("child"), many("sibling"))).alias("pos", "k")).select("id", "pos", "k.*")
    who = named.select(F.col("id").alias("other"), F.lit(True).alias("known"), F.col("norm_first").alias("f"), F.coalesce("norm_last", "norm_maiden").alias("l"))
    # a written table is small next to its rows in memory, so Spark would send all people whole, through the driver
    kin = links.join(who.hint("merge"), "other", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "other", F.coalesce("known", F.lit(False)).alias("known"), "f", "l"))).alias("kin"))
    return rows.withColumns(tokens()).join(kin.hint("merge"), "id", "left")


normal = names.normalize


def people_names(df: DataFrame) -> DataFrame:
    maiden = F.col("maiden") if "maiden" in df.columns else F.lit(None).cast("string")
    return df.select(F.col("id").cast("string").alias("id"), names.normalize(F.col("first")).alias("norm_first"), names.normalize(F.col("last")).alias("norm_last"), names.comparison_form(maiden).alias("norm_maiden"))


def _dictionary() -> Column:
    """Names and those linked with them; of a fixed size, folded to one literal."""
    linked: dict[str, list[str]] = {}
    for a, b in variants.edges():
        linked.setdefault(a, []).append(b)
    return F.from_json(F.lit(json.dumps(linked)), "map<string,array<string>>")


def _marked(name: Column) -> Column:
    """A name as it is compared: in lower case and normalised, apart from each other."""
    return F.array(F.concat(F.lit("l:"), F.lower(F.trim(name))), F.concat(F.lit("n:"), normal(name)))


def _linked(name: Column) -> Column:
    """The dictionary's names for it, marked alike."""
    found = lambda mark, x: F.transform(F.coalesce(F.element_at(_dictionary(), x), F.array().cast("array<string>")), lambda y: F.concat(F.lit(mark), y))
    return F.concat(found("l:", F.lower(F.trim(name))), found("n:", normal(name)))


TOKENS = ("first_own", "first_linked", "all_own", "all_linked", "born", "place", "place_words")


def tokens() -> dict[str, Column]:
    """What pairs compare of people(), made once for each person instead of once for each pair.

    Two names are equivalent if they, or their normalised forms, are equal or linked by the dictionary: own names against own and linked ones.
    """
    every = F.filter(F.concat(F.array("first", "nickname", "middle"), F.col("variants")), lambda x: F.length(x) > 0)
    some = lambda f, xs: F.array_distinct(F.filter(F.flatten(F.transform(xs, f)), lambda x: x.isNotNull()))
    place = names.normalize_place(F.col("birth_place"))
    return {
        "first_own": some(_marked, F.array("first")), "first_linked": some(_linked, F.array("first")), "all_own": some(_marked, every), "all_linked": some(_linked, every),
        "born": normal(F.col("maiden")), "place": place, "place_words": place_words(place),
    }


def place_words(place: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(place, "[, ]"), F.trim), lambda t: F.length(t) > 2))


def alike(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity in Arrow batches: 1 for equal names without Python, and each distinct pair of a batch once."""

    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        codes, pairs = pd.factorize(x + "\n" + y)  # a null in either is no pair
        values = np.array([similarity.cached(*p.split("\n", 1)) for p in pairs] + [np.nan])
        return pd.Series(values[codes])

    return F.when(a == b, 1.0).otherwise(compare(F.when(a != b, a), F.when(a != b, b)))


def first_ladder(jw: Column) -> Column:
    """Equal forms 1, dictionary 0.95, any two of the given names and nicknames 0.90, else the similarity, at least 0.85 for a contained name above 0.7.

    A normalised name has no blanks, so a rule for its first word has nothing to tell apart.
    """
    a, b = F.col("s_norm_first"), F.col("d_norm_first")
    meet = lambda c: F.arrays_overlap(f"s_{c}_own", f"d_{c}_own") | F.arrays_overlap(f"s_{c}_linked", f"d_{c}_own")
    inside = (a.contains(b) | b.contains(a)) & (jw > 0.7)
    ladder = F.when(a == b, 1.0).when(meet("first"), 0.95).when(meet("all"), 0.90)
    return F.when(a.isNotNull() & b.isNotNull(), ladder.when(inside, F.greatest(jw, F.lit(0.85))).otherwise(jw))


def last_ladder(jw: Column) -> Column:
    """Equal forms 1, a maiden name 0.95, else the similarity; a maiden name in place of a missing surname 1, a missing one 0.3."""
    a, b, ma, mb = (F.col(c) for c in ("s_norm_last", "d_norm_last", "s_norm_maiden", "d_norm_maiden"))
    born = F.coalesce(ma == b, F.lit(False)) | F.coalesce(mb == a, F.lit(False))
    counted = (a.isNotNull() & b.isNotNull()) | (ma.isNotNull() & b.isNotNull()) | (a.isNotNull() & mb.isNotNull())
    short = F.when((a.isNull() & F.coalesce(ma == b, F.lit(False))) | (b.isNull() & F.coalesce(mb == a, F.lit(False))), 1.0).otherwise(0.3)
    return F.when(counted, F.when(a.isNull() | b.isNull(), short).when(a == b, 1.0).when(born, 0.95).otherwise(jw))


def maiden_ladder(jw: Column) -> Column:
    a, b = F.col("s_norm_maiden"), F.col("d_norm_maiden")
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).when(F.coalesce(F.col("s_born") == F.col("d_born"), F.lit(False)), 0.95).otherwise(jw))


def places() -> Column:
    """Equal 1, contained 0.8, else the common share of words longer than two letters."""
    x, y = F.col("s_place"), F.col("d_place")
    a, b = place_words(x), place_words(y)
    share = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    return F.when(x.isNotNull() & y.isNotNull(), F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.8).otherwise(share))


def event(name: str) -> Column:
    """Similarity of two imprecise dates of a pair."""
    part = lambda p, x: F.col(f"{p}_{name}_{x}")
    precision = lambda p: F.when(part(p, "day").isNotNull() & part(p, "month").isNotNull(), 2).when(part(p, "month").isNotNull(), 1).otherwise(0)
    same = lambda x: F.coalesce(part("s", x) == part("d", x), F.lit(False))
    found = dates.similarity(part("s", "year"), part("d", "year"), precision("s"), precision("d"), same("month"), same("day"))
    return F.when(part("s", "year").isNotNull() & part("d", "year").isNotNull(), found)


def kin_alike(a: tuple, b: tuple) -> float:
    """Two relatives by (first, last): 1, 0.5 or 0."""
    if not a[0] or not b[0]:
        return 0.0
    first = similarity.cached(a[0], b[0])
    if first < 0.8:
        return 0.0
    if not a[1] or not b[1]:
        return 1.0 if first >= 0.9 else 0.5
    both = (first + similarity.cached(a[1], b[1])) / 2
    return 1.0 if both >= 0.85 else 0.5 if both >= 0.7 else 0.0


def kin_share(kind: str, s: list, d: list) -> float:
    """Part of a kind of relatives that agrees. A relative: (id, known, first, last)."""
    if not s or not d:
        return 0.0
    if kind in ("father", "mother"):
        a, b = s[0], d[0]
        return kin_alike(a[2:], b[2:]) if a[1] and b[1] else float(a[0] == b[0])
    left, right = [x for x in s if x[1]], [x for x in d if x[1]]
    if not left or not right:
        ids = {x[0] for x in s}, {x[0] for x in d}
        return len(ids[0] & ids[1]) / len(ids[0] | ids[1])
    free, matched = list(right), 0
    for a in left:
        hit = next((b for b in free if kin_alike(a[2:], b[2:]) >= SAME), None)
        if hit is not None:
            free.remove(hit)
            matched += 1
    return matched / max(len(left), len(right))


def family_of(s: list, d: list) -> tuple[float, bool, bool]:
    """(similarity of the families, both parents agree, parents and all children agree). Relatives are (kind, id, known, first, last)."""
    by = lambda rows, kind: [r[1:] for r in rows if r[0] == kind]
    points = most = 0.0
    for kind, weight in KIN.items():
        a, b = by(s, kind), by(d, kind)
        if a or b:
            most += weight
            points += weight * kin_share(kind, a, b)
    parents = all(by(s, k) and by(d, k) and by(s, k)[0][1] and by(d, k)[0][1] and kin_alike(by(s, k)[0][2:], by(d, k)[0][2:]) >= SAME for k in ("father", "mother"))
    a, b = by(s, "child"), by(d, "child")
    whole = parents and 0 < len(a) == len(b) and all(x[1] for x in a + b) and all(any(kin_alike(x[2:], y[2:]) >= SAME for y in b) for x in a)
    return points / most if most else 0.0, bool(parents), bool(whole)


def kin_text(kin: Column) -> Column:
    """A person's relatives as one text, which crosses to Python cheaply; null for none."""
    one = lambda k: F.concat_ws("\x01", k["kind"], k["other"], k["known"].cast("string"), F.coalesce(k["f"], F.lit("\x03")), F.coalesce(k["l"], F.lit("\x03")))
    return F.array_join(F.transform(kin, one), "\x02")


@lru_cache(1 << 16)
def _kin_of(text: str) -> list:
    rows = [x.split("\x01") for x in text.split("\x02")] if text else []
    return [(kind, other, known == "true", *(None if n == "\x03" else n for n in names_)) for kind, other, known, *names_ in rows]


def families_of(s: Column, d: Column) -> Column:
    """family, parents and whole of two kin_text()s."""

    @F.pandas_udf("family double, parents boolean, whole boolean")
    def compare(s: pd.Series, d: pd.Series) -> pd.DataFrame:
        # people of one family have the same relatives: each distinct pair of a batch is compared once
        codes, pairs = pd.factorize(s.fillna("") + "\n" + d.fillna(""))
        found = pd.DataFrame([family_of(*map(_kin_of, p.split("\n", 1))) for p in pairs], columns=["family", "parents", "whole"])
        return found.iloc[codes].reset_index(drop=True)

    return compare(s, d)


def fields(pairs: DataFrame) -> DataFrame:
    """pairs has every column of people() as s_ and d_; adds first_sim, last_sim, maiden_sim, birth_sim, place_sim, death_sim (null: not compared) and fam."""
    return with_families(own_fields(pairs))


#: What a pair needs of both sides for own_fields(), if its first_sim is there: no arrays.
SLIM = ("id", "gender", "norm_last", "norm_maiden", "born", "place", "first_key", *YEARS)


def first_key() -> Column:
    """A text that tells everything that given names are compared by."""
    return F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x02")) for c in ("first", "nickname", "middle")], "variants")


def nameless(df: DataFrame) -> DataFrame:
    """people() with first_key but without what the dictionary says of given names, which is dear for each person and which first_sims() makes for each name."""
    return people(df).withColumn("first_key", first_key()).drop(*TOKENS[:4])


def fields_of(pairs: DataFrame, left: DataFrame, right: DataFrame, scratch: Scratch) -> DataFrame:
    """As fields(), for pairs (src_id, dst_id) of nameless() people, both written: given names are compared once for each distinct pair, and the arrays that this takes stay out of the joins of pairs."""
    slim = lambda df: df.select(*SLIM)
    rows = scratch.keep(paired(pairs, slim(left), slim(right)), "pairs")
    firsts = scratch.keep(first_sims(rows, left, right), "first")
    rows = own_fields(rows.join(firsts, ["s_first_key", "d_first_key"])).select("s_id", "d_id", "s_gender", "d_gender", *[f"{c}_sim" for c in FIELDS])
    kin = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.col("kin").alias(f"{p}_kin"))
    return with_families(rows.join(kin(left, "s").hint("merge"), "s_id").join(kin(right, "d").hint("merge"), "d_id"))


def first_sims(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """s_first_key, d_first_key and first_sim of the distinct pairs of given names among pairs; left and right are people with first_key. Tokens that they lack are made once for each name."""
    ship(pairs.sparkSession)

    def side(df: DataFrame, p: str) -> DataFrame:
        df = df.dropDuplicates(["first_key"])
        df = df if TOKENS[0] in df.columns else df.withColumns(tokens())
        return df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("first_key", "norm_first", *TOKENS[:4])])

    rows = pairs.select("s_first_key", "d_first_key").distinct().join(side(left, "s").hint("merge"), "s_first_key").join(side(right, "d").hint("merge"), "d_first_key")
    rows = rows.withColumn("__first", alike(F.col("s_norm_first"), F.col("d_norm_first")))
    return rows.select("s_first_key", "d_first_key", first_ladder(F.col("__first")).alias("first_sim"))


def with_families(pairs: DataFrame) -> DataFrame:
    """pairs with fam, from s_kin and d_kin; who has no relatives isn't sent to Python."""
    ship(pairs.sparkSession)
    none = F.struct(F.lit(0.0).alias("family"), F.lit(False).alias("parents"), F.lit(False).alias("whole"))
    return pairs.withColumn("fam", F.when(F.col("s_kin").isNull() & F.col("d_kin").isNull(), none).otherwise(families_of(kin_text(F.col("s_kin")), kin_text(F.col("d_kin")))))


def own_fields(pairs: DataFrame) -> DataFrame:
    """As fields(), but without relatives; s_kin and d_kin aren't needed."""
    ship(pairs.sparkSession)
    own = () if "first_sim" in pairs.columns else ("first",)
    jw = {f"__{c}": alike(F.col(f"s_norm_{c}"), F.col(f"d_norm_{c}")) for c in (*own, "last", "maiden")}
    return pairs.withColumns(jw).withColumns({
        "first_sim": first_ladder(F.col("__first")) if own else F.col("first_sim"), "last_sim": last_ladder(F.col("__last")), "maiden_sim": maiden_ladder(F.col("__maiden")),
        "birth_sim": event("birth"), "place_sim": places(), "death_sim": event("death"),
    }).drop(*jw)


def _shares(w: dict) -> dict:
    return {"first": w["first"], "last": w["last"], "maiden": w["last"] * MAIDEN_SHARE, "birth": w["birth"], "place": w["place"], "death": w["death"]}


def _same_gender() -> Column:
    """An unknown gender is no mismatch."""
    return (F.col("s_gender") == F.col("d_gender")) | (F.col("s_gender") == "Unknown") | (F.col("d_gender") == "Unknown")


def _points(w: dict, family: Column) -> tuple[Column, Column]:
    """Points, and the points that were possible: those of the fields that both have, of gender and of relatives."""
    shares = _shares(w)
    points = sum((F.coalesce(F.col(f"{c}_sim") * x, F.lit(0.0)) for c, x in shares.items()), F.when(_same_gender(), float(w["gender"])).otherwise(0.0) + family * w["family"])
    return points, sum((F.when(F.col(f"{c}_sim").isNotNull(), float(x)).otherwise(0.0) for c, x in shares.items()), F.lit(float(w["gender"] + w["family"])))


def least_possible(weights: dict | None = None) -> Column:
    """The score that pairs with own_fields() have at least, whatever their relatives are."""
    points, most = _points(WEIGHTS | (weights or {}), F.lit(0.0))
    return F.when(most > 0, F.least(F.lit(85.0), 100 * points / most)).otherwise(0.0)


def bonuses() -> dict[str, Column]:
    """What people() must have for points and bonuses of relatives: any, both parents with names, a child."""
    named = lambda kind: F.exists("kin", lambda k: (k["kind"] == kind) & k["known"] & k["f"].isNotNull())
    flag = lambda c: F.coalesce(c, F.lit(False))
    return {"has_kin": F.col("kin").isNotNull(), "has_parents": flag(named("father") & named("mother")), "has_child": flag(F.exists("kin", lambda k: k["kind"] == "child"))}


def most_possible(weights: dict | None = None) -> Column:
    """The largest score that pairs with own_fields() and both sides' bonuses() can have, whatever their relatives are: all that both have agree, and give the bonuses that both can give."""
    both = lambda c: F.col(f"s_{c}") & F.col(f"d_{c}")
    points, most = _points(WEIGHTS | (weights or {}), F.when(both("has_kin"), 1.0).otherwise(0.0))
    return F.when(most > 0, 100 * points / most).otherwise(0.0) + F.when(both("has_parents"), F.when(both("has_child"), 20).otherwise(10)).otherwise(0)


def scored(pairs: DataFrame, weights: dict | None = None) -> DataFrame:
    """src_id, dst_id, score and reasons (field, points) of pairs with fields().

    Reasons name every field that both have, a mismatch of genders, relatives, the bonuses of parents and of whole families, and what the cap took.
    """
    w = WEIGHTS | (weights or {})
    family, (points, most) = F.col("fam.family"), _points(w, F.col("fam.family"))
    score = F.when(most > 0, 100 * points / most).otherwise(0.0) + F.when(F.col("fam.parents"), 10.0).otherwise(0.0) + F.when(F.col("fam.whole"), 10.0).otherwise(0.0)
    capped = (family < 0.1) & (score > 85) & F.lit(w["family"] > 0)
    said = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("field"), value.cast("double").alias("points")))
    reasons = [said(F.col(f"{c}_sim").isNotNull(), c, F.col(f"{c}_sim") * x) for c, x in _shares(w).items()]
    reasons += [said(~_same_gender(), "gender", F.lit(-w["gender"])), said(family > 0, "family", family * w["family"]), said(F.col("fam.parents"), "both_parents", F.lit(10)), said(F.col("fam.whole"), "whole_family", F.lit(10)), said(capped, "no_family", 85 - score)]
    reasons = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    score = F.when(capped, 85.0).otherwise(score)
    return pairs.select(F.col("s_id").alias("src_id"), F.col("d_id").alias("dst_id"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"), reasons.alias("reasons"))


def paired(pairs: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """src_id, dst_id with both sides' columns; src and dst come from people()."""
    side = lambda df, p: df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])
    keyed = pairs.select(F.col("src_id").cast("string").alias("s_id"), F.col("dst_id").cast("string").alias("d_id"))
    return keyed.join(side(src, "s").hint("merge"), "s_id").join(side(dst, "d").hint("merge"), "d_id")


class Scorer:
    """The score of one pair in Python, by the rules of scored(), for walks that ask for pairs as they go. A person: a mapping of the columns of people()."""

    def __init__(self, weights: dict | None = None):
        self.weights = WEIGHTS | (weights or {})

    def first(self, s, d) -> float | None:
        a, b = s["norm_first"], d["norm_first"]
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        for rank, kind in ((0.95, "first"), (0.90, "all")):
            if not set(d[f"{kind}_own"]).isdisjoint([*s[f"{kind}_own"], *s[f"{kind}_linked"]]):
                return rank
        found = similarity.cached(a, b)
        return max(found, 0.85) if (a in b or b in a) and found > 0.7 else found

    @staticmethod
    def last(s, d) -> float | None:
        a, b, born_a, born_b = s["norm_last"], d["norm_last"], s["norm_maiden"], d["norm_maiden"]
        if a is None or b is None:
            if (b is not None and born_a is not None) or (a is not None and born_b is not None):
                return 1.0 if (a is None and born_a == b) or (b is None and born_b == a) else 0.3
            return None
        return 1.0 if a == b else 0.95 if b == born_a or a == born_b else similarity.cached(a, b)

    @staticmethod
    def maiden(s, d) -> float | None:
        a, b = s["norm_maiden"], d["norm_maiden"]
        if a is None or b is None:
            return None
        return 1.0 if a == b else 0.95 if s["born"] is not None and s["born"] == d["born"] else similarity.cached(a, b)

    @staticmethod
    def event(s, d, name: str) -> float | None:
        (ya, ma, da), (yb, mb, db) = (tuple(p[f"{name}_{x}"] for x in ("year", "month", "day")) for p in (s, d))
        if ya is None or yb is None:
            return None
        gap = abs(ya - yb)
        if gap:
            return next((x for most, x in ((1, 0.8), (2, 0.6), (5, 0.4), (10, 0.2)) if gap <= most), 0.0)
        if ma is None or mb is None:
            return 0.9
        return 0.85 if ma != mb else 1.0 if da is not None and da == db else 0.95

    @staticmethod
    def place(s, d) -> float | None:
        x, y = s["place"], d["place"]
        if x is None or y is None:
            return None
        if x == y or x in y or y in x:
            return 1.0 if x == y else 0.8
        a, b = set(s["place_words"]), set(d["place_words"])
        return len(a & b) / len(a | b) if a and b else 0.0

    def __call__(self, s, d) -> float:
        found = {"first": self.first(s, d), "last": self.last(s, d), "maiden": self.maiden(s, d), "birth": self.event(s, d, "birth"), "place": self.place(s, d), "death": self.event(s, d, "death")}
        rows = [[] if p["kin"] is None else [(k["kind"], k["other"], k["known"], k["f"], k["l"]) for k in p["kin"]] for p in (s, d)]
        family, parents, whole = family_of(*rows)
        shares, w = _shares(self.weights), self.weights
        same = "Unknown" in (s["gender"], d["gender"]) or s["gender"] == d["gender"]
        points = sum(shares[c] * x for c, x in found.items() if x is not None) + w["gender"] * same + w["family"] * family
        most = sum(shares[c] for c, x in found.items() if x is not None) + w["gender"] + w["family"]
        score = (100 * points / most if most else 0.0) + 10 * parents + 10 * whole
        return 85.0 if w["family"] > 0 and family < 0.1 and score > 85 else max(0.0, min(100.0, score))

"""Candidate pairs of people by an inverted index of block keys.

A person stands in the index under a skeleton and a prefix of its surname and maiden name, a dictionary class and a prefix of its given name, and its parents' given names.
Every block is cut by the birth year in buckets as wide as the largest distance that may match, and the source's rows look into three buckets, so no block grows beyond one
window of years; people without a year meet the whole block. Nothing is purged: a large block is only cut finer. A pair that shares several keys comes out of the first of them alone,
so pairs need no distinct. `save` keeps an index as a bucketed, sorted table; two such tables join without a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locales, names, variants

HARD_YEARS = 15
#: The last two join all bearers of a given name in a window of years, whatever their surnames are; they are left to those who ask for them.
EVERY = ("surname", "surname_start", "given_surname", "parents", "given", "given_start")
KINDS = EVERY[:4]
#: Letters of a beginning.
START = {"surname": 4, "given": 2, "parents": 2}


def _classes() -> Column:
    """Given names of the dictionary and the first name of their group; of a fixed size, folded to one literal."""
    root: dict[str, str] = {}

    def top(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in variants.edges():
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return F.from_json(F.lit(json.dumps({x: top(x) for x in root})), "map<string,string>")


def given_class(raw: Column, normal: Column) -> Column:
    """The dictionary's group of a given name as written or transliterated; the normalised name where it has none."""
    return F.coalesce(F.element_at(_classes(), F.lower(F.trim(raw))), F.element_at(_classes(), normal), normal)


def skeleton(surname: Column) -> Column:
    """The consonants of a surname's base form, doubles once, w as v."""
    base = names.normalize(locales.surname_base(surname))
    bare = F.translate(F.regexp_replace(base, "(?<=.)[aeiouyh]", ""), "w", "v")
    return F.nullif(F.regexp_replace(bare, r"(.)\1+", "$1"), F.lit(""))


def keys(kinds: tuple[str, ...] = KINDS) -> Column:
    """The distinct block keys of a person of compare.people()."""
    parent = lambda kind: F.get(F.filter("kin", lambda k: (k["kind"] == kind) & k["known"]), F.lit(0))["f"]
    start = lambda name: F.concat(F.lit("^"), F.substring(name, 1, START["parents"]))
    group = lambda name: F.coalesce(F.element_at(_classes(), name), name)
    found = {
        "surname": [skeleton(F.col("last")), skeleton(F.col("maiden"))],
        "surname_start": [F.substring(names.normalize(F.col(c)), 1, START["surname"]) for c in ("last", "maiden")],
        "given_surname": [F.concat(x, F.lit("|"), F.substring(names.normalize(F.col(c)), 1, 1)) for x in (given_class(F.col("first"), F.col("norm_first")), F.substring("norm_first", 1, START["given"])) for c in ("last", "maiden")],
        "given": [given_class(F.col("first"), F.col("norm_first"))],
        "given_start": [F.substring("norm_first", 1, START["given"])],
        "parents": [F.concat(f(parent("father")), F.lit("|"), f(parent("mother"))) for f in (group, start)],
    }
    marked = [F.concat(F.lit(f"{EVERY.index(k)}:"), x) for k in kinds for x in found[k]]
    return F.array_sort(F.array_distinct(F.filter(F.array(*marked), lambda x: x.isNotNull())))


def index(people: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """key, bucket (of the birth year, null without one), id, gender, birth_year and all keys of each person, a row for each key.

    people may have its keys already, as a column.
    """
    own = F.col("keys") if "keys" in people.columns else keys(kinds).alias("keys")
    rows = people.select("id", "gender", "birth_year", own, F.floor(F.col("birth_year") / (HARD_YEARS + 1)).alias("bucket"))
    return rows.select(F.explode("keys").alias("key"), "bucket", "id", "gender", "birth_year", "keys")


def save(people: DataFrame, name: str, buckets: int = 64, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The index as a table of the warehouse, bucketed and sorted by key; give both trees' tables the same number of buckets."""
    index(people, kinds).write.mode("overwrite").format("parquet").bucketBy(buckets, "key").sortBy("key", "bucket").saveAsTable(name)
    return people.sparkSession.table(name)


def fits(s: str = "s", d: str = "d") -> Column:
    """Genders that don't clash, birth years that aren't known to be more than HARD_YEARS apart."""
    clash = (F.col(f"{s}_gender") != "Unknown") & (F.col(f"{d}_gender") != "Unknown") & (F.col(f"{s}_gender") != F.col(f"{d}_gender"))
    return ~clash & ~F.coalesce(F.abs(F.col(f"{s}_birth_year") - F.col(f"{d}_birth_year")) > HARD_YEARS, F.lit(False))


def pairs(src_index: DataFrame, dst_index: DataFrame) -> DataFrame:
    """src_id and dst_id of people who share a key and fit; each pair once. The join is by key, years and genders are further conditions of it."""
    side = lambda df, p: df.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("bucket", "id", "gender", "birth_year", "keys")])
    near = F.coalesce(F.abs(F.col("s_bucket") - F.col("d_bucket")) <= 1, F.lit(True))
    first = F.array_min(F.array_intersect("s_keys", "d_keys")) == F.col("key")
    return side(src_index, "s").join(side(dst_index, "d"), "key").where(near & fits() & first).select(F.col("s_id").alias("src_id"), F.col("d_id").alias("dst_id"))


def candidates(src: DataFrame, dst: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """src_id and dst_id of two trees of compare.people(), each pair once.

    People with years are joined by (key, bucket), the source three times; people without one, on either side, by key.
    """
    s, d = index(src, kinds), index(dst, kinds)
    wide = s.where("bucket is not null").withColumn("at", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    left = lambda df: df.select("key", *[c for c in ("at",) if c in df.columns], *[F.col(c).alias(f"s_{c}") for c in ("id", "gender", "birth_year", "keys")])
    right = lambda df: df.select("key", F.col("bucket").alias("at"), *[F.col(c).alias(f"d_{c}") for c in ("id", "gender", "birth_year", "keys")])
    first = F.array_min(F.array_intersect("s_keys", "d_keys")) == F.col("key")
    out = lambda df: df.where(fits() & first).select(F.col("s_id").alias("src_id"), F.col("d_id").alias("dst_id"))
    dated = out(left(wide).join(right(d.where("bucket is not null")), ["key", "at"]))
    undated = out(left(s.where("bucket is null")).join(right(d).drop("at"), "key"))
    return dated.unionByName(undated).unionByName(out(left(s.where("bucket is not null")).join(right(d.where("bucket is null")).drop("at"), "key")))


def all_pairs(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Every pair that fits, whatever its keys: what blocking is measured against. People with years meet in buckets, those without one meet all."""
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "gender", "birth_year")], F.floor(F.col("birth_year") / (HARD_YEARS + 1)).alias(f"{p}_bucket"))
    left, right = side(src, "s"), side(dst, "d")
    wide = left.where("s_bucket is not null").withColumn("at", F.explode(F.array(F.col("s_bucket") - 1, F.col("s_bucket"), F.col("s_bucket") + 1)))
    dated = wide.join(right.where("d_bucket is not null"), F.col("at") == F.col("d_bucket")).where(fits())
    rest = left.where("s_bucket is null").join(right, fits()).unionByName(left.where("s_bucket is not null").join(right.where("d_bucket is null"), fits()))
    return dated.drop("at").unionByName(rest).select(F.col("s_id").alias("src_id"), F.col("d_id").alias("dst_id"))


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The part of wanted (src_id, dst_id) that found holds; 1 if nothing is wanted."""
    hit = found.select("src_id", "dst_id", F.lit(True).alias("hit"))
    n = wanted.join(hit, ["src_id", "dst_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("h")).first()
    return n["h"] / n["n"] if n["n"] else 1.0

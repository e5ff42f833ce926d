"""Perceptual hashes: the mean hash of small images, its text form, and a near search over all hashes.

Two hashes of 64 bits that differ in at most MOST bits agree in one of MOST + 1 bands at least (there are more bands than differing bits), so pairs meet
in an equi-join by (band, bits) and the distance is then taken exactly. Equal hashes are one row, however many images bear them, and a pair that shares several bands
comes out of the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity

PREFIX = "phash:0x"
BITS = 64
#: A similarity of 0.95 lets 3 of 64 bits differ.
MOST = 3


def mean_hash(pixels: Column) -> Column:
    """64 brightness values, row by row, as a 64-bit number: a bit is 1 where the value is above the mean, the first value's bit most significant. Null for other sizes or a missing value."""
    values = F.transform(pixels, lambda x: x.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / BITS
    whole = (F.size(pixels) == BITS) & ~F.exists(pixels, lambda x: x.isNull())
    bits = F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > mean, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return F.when(whole, bits)


def signature(content_sha256: Column, hash_: Column) -> Column:
    """The text that names an image's content and look: the perceptual hash where there is one, else the content's."""
    return F.coalesce(F.concat(F.lit(PREFIX), F.lower(F.lpad(F.hex(hash_), 16, "0"))), F.nullif(F.lower(F.trim(content_sha256)), F.lit("")))


def from_signature(text: Column) -> Column:
    """The perceptual hash of a signature; null for one of contents, or none."""
    found = F.regexp_extract(F.trim(text), "(?i)^phash:(?:0x)?([0-9a-f]{1,16})$", 1)
    high, low = (F.conv(F.substring(F.lpad(found, 16, "0"), at, 8), 16, 10).cast("long") for at in (1, 9))
    return F.when(found != "", F.shiftleft(high, 32).bitwiseOR(low))


def bands(hash_: Column, most: int = MOST) -> Column:
    """The hash's bits cut into most + 1 runs of nearly equal width."""
    edges = [BITS * i // (most + 1) for i in range(most + 2)]
    mask = lambda n: (1 << n) - 1
    return F.array(*[F.shiftrightunsigned(hash_, a).bitwiseAND(F.lit(mask(b - a) if b - a < 64 else -1).cast("long")) for a, b in zip(edges, edges[1:], strict=False)])


def near_hashes(hashes: DataFrame, most: int = MOST) -> DataFrame:
    """a, b (a < b as numbers) and similarity of all pairs of different hashes within the distance; hashes has hash."""
    rows = hashes.where("hash is not null").select("hash").distinct().withColumn("bands", bands(F.col("hash"), most))
    keyed = rows.select("hash", "bands", F.posexplode("bands").alias("band", "bits"))
    pairs = keyed.select("band", "bits", F.col("hash").alias("a"), F.col("bands").alias("a_bands")).join(keyed.select("band", "bits", F.col("hash").alias("b"), F.col("bands").alias("b_bands")), ["band", "bits"]).where("a < b")
    first = F.array_position(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), F.lit(True)) - 1 == F.col("band")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return pairs.where(first & (distance <= most)).select("a", "b", similarity.hash_similarity(F.col("a"), F.col("b")).alias("similarity"))


def near_images(images: DataFrame, most: int = MOST) -> DataFrame:
    """id, other and similarity of all pairs of images (id < other) that look alike; images has id and hash. Those of one hash are alike."""
    held = images.where("hash is not null").select("id", "hash")
    same = held.join(held.withColumnRenamed("id", "other"), "hash").where("id < other").select("id", "other", F.lit(1.0).alias("similarity"))
    found = near_hashes(images, most)
    met = found.join(held.withColumnRenamed("hash", "a"), "a").join(held.select(F.col("id").alias("other"), F.col("hash").alias("b")), "b")
    return same.unionByName(met.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "similarity"))


def update_matches(store: DataFrame, found: DataFrame) -> DataFrame:
    """A table of matches (id, other, similarity, both directions) with those found in place of older ones of the same pair; found may name a pair once, either way round."""
    both = found.select("id", "other", "similarity").unionByName(found.select(F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))
    both = both.groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return store.select("id", "other", "similarity").join(both, ["id", "other"], "left_anti").unionByName(both)


def cached(photos: DataFrame, index: DataFrame) -> DataFrame:
    """photos (url) with the hash and content_sha256 that the cache index has for each url (its latest entry by cached_at); a url that it lacks has none."""
    latest = index.groupBy("url").agg(F.max_by(F.struct("hash", "content_sha256"), "cached_at").alias("e"))
    return photos.join(latest, "url", "left").select(*photos.columns, F.col("e.hash").alias("hash"), F.col("e.content_sha256").alias("content_sha256"), F.col("e").isNotNull().alias("is_cached"))

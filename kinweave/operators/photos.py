"""Photo signatures: hashes of content and looks, and greedy matching of two people's photos."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship


def sign_hashes(vectors: DataFrame) -> DataFrame:
    """vec_id and a 64-bit hash of the signs of the first 64 components, the first in the lowest bit."""
    bits = F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return vectors.select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("hash"))


def content_hash(content):
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def match(photos: DataFrame, least: float = 0.95) -> DataFrame:
    """pair, src_url, dst_url, similarity: each source photo in order takes an equal content hash, else the most similar left.

    photos has pair, side (src or dst), pos, url, content_hash and perceptual_hash; a group is the photos of two people.
    """

    def greedy(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        pool = list(block[block.side == "dst"].itertuples())
        rows = []
        for photo in block[block.side == "src"].itertuples():
            hit = next((x for x in pool if photo.content_hash is not None and x.content_hash == photo.content_hash), None)
            score = 1.0
            if hit is None and pd.notna(photo.perceptual_hash):
                scored = [(1 - bin((int(x.perceptual_hash) ^ int(photo.perceptual_hash)) & ((1 << 64) - 1)).count("1") / 64, -i, x) for i, x in enumerate(pool) if pd.notna(x.perceptual_hash)]
                score, _, hit = max(scored, default=(0.0, 0, None), key=lambda t: t[:2])
                hit = hit if score >= least else None
            if hit is not None:
                pool.remove(hit)
            rows.append((photo.pair, photo.url, hit.url if hit else None, score if hit else None))
        return pd.DataFrame(rows, columns=["pair", "src_url", "dst_url", "similarity"])

    ship(photos.sparkSession)
    return photos.select("pair", "side", "pos", "url", "content_hash", "perceptual_hash").groupBy("pair").applyInPandas(greedy, "pair long, src_url string, dst_url string, similarity double")

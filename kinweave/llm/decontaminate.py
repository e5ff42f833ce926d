"""Benchmark decontamination by winnowing, with DataFrame functions only.

The fingerprint of a window of WINDOW words is the smallest hash of its GRAM-word grams: winnowing with
WINDOW - GRAM + 1 grams a window keeps exactly these minima of a document, so every span of WINDOW shared words shares a kept
fingerprint. Distinct kept fingerprints of each document are joined with those of the benchmark. Documents with a hit
are extended: each of their windows whose fingerprint was hit is compared word for word with the
benchmark's windows. An item of fewer than WINDOW words is one window of its own length; documents are searched for it
by the hash of every gram of that length, as winnowing gives no guarantee for shorter spans. All lengths are searched in one pass over the texts.

Defined cases: null and empty texts have no words and no hit; an item without words (or null) occurs nowhere. Equal
items all count. Rows that repeat a doc_id are told apart and each come out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

WINDOW, GRAM = 10, 5
#: A word is a run of these: lower-case letters and digits of ASCII and all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; lower() is the same and faster where the text is ASCII."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _zipped(a: Column, b: Column, shift: int, f) -> Column:
    """f of each element of a and the one of b that is shift places further on."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), f)


def marks(df: DataFrame, lengths: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """df has ws, the words; adds m<length> of each length: by first word, the winnowed minimum of each window, or the hash of each shorter gram.

    A gram's hash grows from that of the gram one word shorter, and a minimum over many grams from two over fewer, so each word costs one step a length.
    """
    df = df.withColumn("g1", F.transform("ws", lambda w: F.xxhash64(w)))
    upto = max([gram if n == window else n for n in lengths], default=1)
    for n in range(2, upto + 1):
        df = df.withColumn(f"g{n}", _zipped(F.col(f"g{n - 1}"), F.col("g1"), n - 1, lambda x, y: F.xxhash64(x, y)))
    if window in lengths:
        df, width, wanted = df.withColumn("least", F.col(f"g{gram}")), 1, window - gram + 1
        while width < wanted:
            shift = min(width, wanted - width)
            df, width = df.withColumn("least", _zipped(F.col("least"), F.col("least"), shift, lambda x, y: F.least(x, y))), width + shift
    return df.withColumns({f"m{n}": F.col("least" if n == window else f"g{n}") for n in lengths}).drop("least", *[f"g{n}" for n in range(1, upto + 1)])


def hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, at, length, wid) of every occurrence of a benchmark window, (wid, item_id), and docs (doc_id, row, text) with n_words for text."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    long_items = items.where(F.size("ws") >= window)
    spans = long_items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - window + 1), lambda i: F.slice("ws", i, window))).alias("ws"))
    spans = scratch.keep(spans.unionByName(items.where(F.size("ws") < window)).select("item_id", "ws", F.concat_ws(" ", "ws").alias("span")).distinct(), "spans")
    windows = scratch.keep(spans.groupBy("span").agg(F.first("ws").alias("ws")).withColumn("wid", F.xxhash64("span")).select("wid", "span", "ws", F.size("ws").alias("length")), "windows")
    owners = spans.join(windows.select("wid", "span"), "span").select("wid", "item_id").distinct()
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    own = F.coalesce(*[F.when(F.col("length") == n, F.col(f"m{n}")[0]) for n in lengths], F.lit(None).cast("long"))
    keys = scratch.keep(marks(windows, lengths, window, gram).select(own.alias("m"), "length").distinct(), "keys")
    # a window's minimum recurs over its neighbours; grams of one length seldom do
    every = F.concat(F.array(F.xxhash64("row")), *[F.array_distinct(f"m{n}") if n == window else F.col(f"m{n}") for n in lengths])
    # splitting a text into words is the dearest step: one pass gives a first row with the words' number, and a row for each fingerprint that is hit
    split = docs.select("doc_id", "row", words(F.col("text")).alias("ws"))
    found = marks(split, lengths, window, gram).select("doc_id", "row", F.size("ws").cast("long").alias("n_words"), F.posexplode(every).alias("pos", "m"))
    found = found.join(keys.select("m", F.lit(True).alias("hit")).distinct(), "m", "left").where("pos = 0 or hit")
    scanned = scratch.keep(found.select("doc_id", "row", "n_words", "pos"), "scanned")
    counts, touched = scanned.where("pos = 0").select("doc_id", "row", "n_words"), scanned.where("pos > 0").select("row").distinct()
    if not lengths:
        return docs.select("row", F.lit(0).alias("at"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("wid")).where("false"), owners, counts
    # touched documents have words; a filter on them would be pushed below the join and split every text
    held = docs.join(touched, "row", "left_semi").dropDuplicates(["row"]).select("row", words(F.col("text")).alias("ws"))
    held = scratch.keep(held, "held")

    def places(n: int) -> Column:
        return F.transform(f"m{n}", lambda x, i: F.struct(i.alias("at"), F.lit(n).alias("length"), x.alias("m")))

    spots = marks(held, lengths, window, gram).select("row", F.explode(F.concat(*[places(n) for n in lengths])).alias("e")).select("row", "e.*")
    # only windows whose fingerprint was hit are written out as words
    spots = spots.join(keys, ["m", "length"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("at", "length")).alias("spots"))
    spelt = F.transform("spots", lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"), F.concat_ws(" ", F.slice("ws", x["at"] + 1, x["length"])).alias("span")))
    spelt = held.join(spots, "row").select("row", F.explode(spelt).alias("e")).select("row", "e.*")
    return spelt.join(windows.select("span", "length", "wid"), ["span", "length"]).select("row", "at", "length", "wid"), owners, counts


def covered(spots: Column) -> Column:
    """Number of positions inside any (at, length) of a sorted array."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(x["at"] + x["length"] - F.greatest(acc["end"], x["at"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["at"] + x["length"]).alias("end"))
    return F.aggregate(spots, start, step, lambda acc: acc["n"])


def row_of() -> Column:
    """128 bits that name a text of an id: two hashes that begin with different columns, for 64 bits repeat among 10**10 rows."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit("b")).alias("b"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """row = row_of() of the documents that hold a window of the benchmark."""
    docs = docs.select("doc_id", "text").withColumn("row", row_of())
    return hits(docs, benchmark, scratch)[0].select("row").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and row of every row of docs."""
    scratch = scratch or Scratch(docs.sparkSession, "winnow")
    # rows of one doc_id and one text are alike; `row` names a text of an id
    docs = docs.select("doc_id", "text").withColumn("row", row_of())
    found, owners, counts = hits(docs, benchmark, scratch)
    found = scratch.keep(found.distinct(), "found")
    n_hit = found.groupBy("row").agg(covered(F.array_sort(F.collect_set(F.struct("at", "length")))).cast("long").alias("n_hit"))
    named = found.select("row", "wid").distinct().join(owners, "wid").select("row", F.col("item_id").cast("string").alias("item")).where("item is not null").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = scratch.keep(n_hit.join(named, "row", "left"), "hit")
    out = counts.join(hit, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), k AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS span
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), x AS MATERIALIZED (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS span
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(ws) >= n)
), h AS MATERIALIZED (SELECT x.doc_id, x.i, x.n, k.item_id FROM x JOIN k ON x.span = k.span AND x.n = k.n),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""

"""Queries of branch plans, unions, photo hashes, the GEDCOM reader, and of dates, ids, names and thresholds over the tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, locales, names, variants
from ..operators import branch, family, graph, photohash, unions
from ..scratch import Scratch
from ..sources import gedcom
from . import fixture
from .detail import place_sql, roman_sql, surname_sql
from .registry import EDGES_SQL, NAMES, SCRIPT_RANGES, THRESHOLDS_SQL, WORDS_SQL, _table, _words, norm_sql, script_sql, translit_sql

START, ANCHOR, DEPTH = 8, 0, 6


def _relatives(spark, d) -> DataFrame:
    """The source tree's people with their relatives' ids in order."""
    src = fixture.source(spark, d)
    rel = graph.relatives(src)
    lists = rel.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("relation") == k, F.col("other")))).alias(f"{k}_ids") for k in ("spouse", "child")])
    none = F.array().cast("array<bigint>")
    return src.select("id", "father_id", "mother_id").join(lists, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("spouse_ids", "child_ids")})


def q_branch(spark, d):
    return branch.branch_plan(_relatives(spark, d), START, [ANCHOR], DEPTH).select("depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("place"), "src_id", "related_id", "relation")


def _branch_sql() -> str:
    """Levels of the queue as a chain of CTEs; a path of (slot, place) pairs is a person's place in the order."""
    out = f""", cp2 AS (SELECT DISTINCT father_id AS f, mother_id AS m FROM src WHERE father_id IN (SELECT id FROM src) AND mother_id IN (SELECT id FROM src)),
sp AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) - 1 AS nth FROM (SELECT f AS id, m AS other FROM cp2 UNION ALL SELECT m, f FROM cp2)),
ch AS (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY other) - 1 AS nth FROM (SELECT p.id, c.id AS other FROM src c JOIN src p ON p.id IN (c.father_id, c.mother_id))),
ed AS MATERIALIZED (SELECT id, 0 AS slot, nth, other FROM sp UNION ALL SELECT id, 1, 0, father_id FROM src WHERE father_id IS NOT NULL UNION ALL SELECT id, 2, 0, mother_id FROM src WHERE mother_id IS NOT NULL UNION ALL SELECT id, 4, nth, other FROM ch),
f0 AS (SELECT {START}::BIGINT AS id, [0]::BIGINT[] AS path), v0 AS (SELECT {START}::BIGINT AS id UNION ALL SELECT {ANCHOR}), a0 AS (SELECT {ANCHOR}::BIGINT AS id, [-1]::BIGINT[] AS path)"""
    for k in range(DEPTH + 1):
        out += f""",
r{k} AS MATERIALIZED (SELECT {k} AS depth, f.path, f.id, e.other, e.slot, row_number() OVER (PARTITION BY f.id ORDER BY CASE e.slot WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 1 THEN 2 ELSE 3 END, e.nth) AS k
  FROM (SELECT * FROM f{k} WHERE id IN (SELECT id FROM src)) f JOIN ed e ON e.id = f.id JOIN (SELECT id, path FROM a{k} UNION ALL SELECT id, path FROM f{k}) a ON a.id = e.other AND (len(a.path) < len(f.path) OR a.path < f.path)),
a{k + 1} AS MATERIALIZED (SELECT * FROM a{k} UNION ALL SELECT id, path FROM r{k} WHERE k = 1),
f{k + 1} AS MATERIALIZED (SELECT e.other AS id, min(list_concat(r.path, [e.slot, e.nth]::BIGINT[])) AS path FROM (SELECT id, path FROM r{k} WHERE k = 1) r JOIN ed e ON e.id = r.id WHERE e.other NOT IN (SELECT id FROM v{k}) GROUP BY 1),
v{k + 1} AS MATERIALIZED (SELECT id FROM v{k} UNION ALL SELECT id FROM f{k + 1})"""
    return out + " " + " UNION ALL ".join(f"SELECT depth, array_to_string(path, '.') AS place, id AS src_id, other AS related_id, CASE slot WHEN 0 THEN 'Partner' WHEN 4 THEN 'Parent' ELSE 'Child' END AS relation FROM r{k} WHERE k = 1" for k in range(DEPTH + 1))


#: Unions of the target tree: every couple has one, every second couple an ended one before it, every third one after it, and every fifth only the ended one.
UNIONS = """SELECT CONCAT('union-', f, '-', k) AS union_id, CASE WHEN k <> 1 OR MOD(b, 5) = 4 THEN 'ex_spouse' END AS status, f, m, CAST(k AS INT) AS pos
FROM (SELECT DISTINCT father_id AS f, mother_id AS m, CAST(FLOOR(father_id / 7.0) AS BIGINT) AS b FROM {dst} WHERE father_id IS NOT NULL AND mother_id IS NOT NULL) c CROSS JOIN (VALUES (0), (1), (2)) t(k)
WHERE k = 1 OR (k = 0 AND MOD(b, 2) = 0) OR (k = 2 AND MOD(b, 3) = 0)"""


def q_unions(spark, d):
    held = spark.sql(UNIONS.format(dst="{dst}"), dst=fixture.target(spark, d))
    held = held.select("union_id", "status", F.array(F.concat(F.lit("profile-g"), "f"), F.concat(F.lit("https://x/api/profile-"), "m")).alias("partners"), F.array().cast("array<string>").alias("children"), "pos")
    new = fixture.source(spark, d).select("id", F.concat(F.lit("g"), "father_id").alias("father_profile"), F.col("mother_id").cast("string").alias("mother_profile"))
    return unions.for_children(held, new)


UNIONS_SQL = f""", un AS ({UNIONS.format(dst='dst')}), uc AS (
  SELECT s.id, u.union_id, u.status IS NOT NULL AS is_ex, count(*) OVER (PARTITION BY s.id) AS n_unions, row_number() OVER (PARTITION BY s.id ORDER BY u.status IS NOT NULL, u.pos, u.union_id) AS k
  FROM src s JOIN un u ON u.f = s.father_id AND u.m = s.mother_id
) SELECT s.id, c.union_id, c.n_unions, c.is_ex FROM src s LEFT JOIN uc c ON c.id = s.id AND c.k = 1"""


def q_repair(spark, d):
    """The repair walk over the unions of the fixture's couples and children, from the first person."""
    src = fixture.source(spark, d).where("father_id is not null and mother_id is not null")
    rows = src.select(F.concat_ws("-", "father_id", "mother_id").alias("union_id"), F.explode(F.array("id", "father_id", "mother_id")).alias("id"))
    return branch.repair_frontier(rows, ANCHOR, 4)


REPAIR_SQL = """, me AS (SELECT DISTINCT father_id || '-' || mother_id AS u, unnest([id, father_id, mother_id]) AS id FROM src WHERE father_id IS NOT NULL AND mother_id IS NOT NULL),
wk AS (SELECT 0 AS depth, 0::BIGINT AS id UNION SELECT wk.depth + 1, b.id FROM wk JOIN me a ON a.id = wk.id JOIN me b ON b.u = a.u WHERE wk.depth < 4)
SELECT min(depth)::INT AS depth, id FROM wk GROUP BY id"""


#: Two images of each vector: its first 64 components, and these with up to four of them turned over.
IMAGE = "CASE WHEN t.k = 1 AND i <= MOD(vec_id, 5) THEN -x ELSE x END"


def _hashes(spark, d) -> DataFrame:
    rows = _table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 64).alias("e"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    pixels = F.transform("e", lambda x, i: F.when((F.col("k") == 1) & (i + 1 <= F.col("vec_id") % 5), -x).otherwise(x))
    return rows.select((2 * F.col("vec_id") + F.col("k")).alias("id"), photohash.mean_hash(pixels).alias("hash"))


def q_mean_hash(spark, d):
    rows = _hashes(spark, d).withColumn("signature", photohash.signature(F.lit(None).cast("string"), F.col("hash")))
    return rows.select("id", "signature", photohash.from_signature(F.col("signature")).alias("hash"))


HASH_SQL = f"h AS MATERIALIZED (SELECT id, list_transform(e, lambda x: x > list_sum(e) / 64) AS s FROM (SELECT 2 * vec_id + t.k AS id, list_transform(embedding[1:64], lambda x, i: {IMAGE}) AS e FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings), (VALUES (0), (1)) t(k)))"
SIGNATURE_SQL = "'phash:0x' || array_to_string(list_transform(range(16), lambda n: lower(to_hex((CASE WHEN s[4 * n + 1] THEN 8 ELSE 0 END + CASE WHEN s[4 * n + 2] THEN 4 ELSE 0 END + CASE WHEN s[4 * n + 3] THEN 2 ELSE 0 END + CASE WHEN s[4 * n + 4] THEN 1 ELSE 0 END)::INT))), '')"
HASH_NUMBER_SQL = "(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN s[i + 1] THEN 1::HUGEINT << (63 - i)::HUGEINT ELSE 0::HUGEINT END)) - CASE WHEN s[1] THEN 9223372036854775808::HUGEINT ELSE 0::HUGEINT END)::BIGINT"

GED = {
    "person": """SELECT CONCAT('0 @I', id, '@ INDI\n1 NAME ', first, ' /', last, '/\n2 GIVN ', first, CASE WHEN MOD(id, 4) = 1 THEN ' Petrovich' ELSE '' END, '\n2 SURN ', last, CASE WHEN MOD(id, 6) = 3 THEN ' (Alt)' ELSE '' END,
CASE WHEN MOD(id, 10) = 7 THEN '\n2 _MARNM Newname' ELSE '' END, '\n1 SEX ', SUBSTR(gender, 1, 1), CASE WHEN birth_year IS NULL THEN '' ELSE CONCAT('\n1 BIRT\n2 DATE ', CASE MOD(id, 4) WHEN 0 THEN '31 FEB ' WHEN 1 THEN 'ABT MAY ' WHEN 2 THEN '7 JUN ' ELSE '' END, birth_year, '\n2 PLAC Moscow') END,
CASE WHEN MOD(id, 5) = 0 THEN '\n1 DEAT\n2 DATE BET 1900 AND 1910' ELSE '' END, '\n1 NOTE one\n2 CONC  two\nthree\n1 RIN ', id) AS value FROM {src}""",
    "family": """SELECT CONCAT('0 @F', father_id, '@ FAM\n1 HUSB @I', father_id, '@', CASE WHEN mother_id IS NULL THEN '' ELSE CONCAT('\n1 WIFE @I', mother_id, '@') END, '\n1 CHIL @I', ARRAY_JOIN(ARRAY_SORT(COLLECT_LIST(LPAD(CAST(id AS STRING), 9, '0'))), '@\n1 CHIL @I'), '@') AS value FROM {src} WHERE father_id IS NOT NULL GROUP BY father_id, mother_id""",
}


def q_gedcom(spark, d):
    """The source tree written as GEDCOM lines by Spark and read again."""
    scratch, src = Scratch(spark, "ged"), fixture.source(spark, d)
    for name, text in GED.items():
        spark.sql(text, src=src).write.text(f"{scratch.root}/text/{name}")
    found = gedcom.people(gedcom.read_records(spark, f"{scratch.root}/text/*", "src", scratch), F.lit(2026))
    number = lambda c: F.regexp_extract(c, "@I0*([0-9]+)@", 1).cast("long")
    return found.select(number(F.col("id")).alias("id"), "first", "middle", "last", "gender", "birth_year", "birth_month", "birth_day", "birth_place", "death_year", "living", F.get("notes", F.lit(0)).alias("note"), F.col("custom_tags")["RIN"].alias("rin"), F.array_join("variants", "|").alias("variants"))


GED_SQL = """, g1 AS (SELECT *, CASE WHEN id % 6 = 3 THEN last || ' (Alt)' ELSE last END AS surn FROM src)
SELECT id, first, CASE WHEN id % 4 = 1 THEN 'Petrovich' END AS middle, CASE WHEN id % 10 = 7 THEN 'Newname' ELSE last END AS last, CASE gender WHEN 'Unknown' THEN 'Unknown' ELSE gender END AS gender, birth_year,
  CASE WHEN birth_year IS NULL THEN NULL WHEN id % 4 = 0 THEN 2 WHEN id % 4 = 1 THEN 5 WHEN id % 4 = 2 THEN 6 END AS birth_month, CASE WHEN birth_year IS NOT NULL AND id % 4 = 2 THEN 7 END AS birth_day, CASE WHEN birth_year IS NOT NULL THEN 'Moscow' END AS birth_place,
  CASE WHEN id % 5 = 0 THEN 1900 END AS death_year, CASE WHEN id % 5 = 0 THEN false WHEN birth_year > 1906 THEN true END AS living, 'one two' || chr(10) || 'three' AS note, id::VARCHAR AS rin,
  first || CASE WHEN id % 4 = 1 THEN ' Petrovich' ELSE '' END || '|' || last || CASE WHEN id % 6 = 3 THEN '|Alt' ELSE '' END AS variants FROM g1"""

NAMES_SQL = f"{WORDS_SQL}, n(name) AS (SELECT word FROM w UNION SELECT unnest([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in NAMES)}]))"


def _names(spark, d) -> DataFrame:
    """The words of all documents and some names."""
    return _words(spark, d).select(F.col("word").alias("name")).union(spark.createDataFrame([(x,) for x in NAMES], "name string")).distinct()


def _surnames(spark, d) -> DataFrame:
    return _names(spark, d).select("name").union(fixture.persons(spark, d).select("src_last")).distinct()


SURNAMES_SQL = f", {NAMES_SQL}, m(name) AS (SELECT name FROM n UNION SELECT src_last FROM persons)"
DATE_TEXT = "CASE MOD(id, 6) WHEN 0 THEN CONCAT('15 JAN ', birth_year) WHEN 1 THEN CONCAT('MAY ', birth_year) WHEN 2 THEN CONCAT('ABT ', birth_year) WHEN 3 THEN CONCAT('31 FEB ', birth_year) WHEN 4 THEN CONCAT('BET 3 OKT ', birth_year, ' AND ', birth_year + 1) ELSE CONCAT('BEF 7 мая ', birth_year) END"


def q_dates(spark, d):
    rows = fixture.persons(spark, d).selectExpr("id", f"{DATE_TEXT} AS text").withColumn("p", dates.parse(F.col("text")))
    return rows.select("id", "p.year", "p.month", "p.day", "p.precision", "p.modifier", dates.form(F.col("p")).alias("form"))


DATES_SQL = """, dt AS (SELECT id, birth_year AS year, CASE id % 6 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 3 THEN 2 WHEN 4 THEN 10 WHEN 5 THEN 5 END AS month, CASE id % 6 WHEN 0 THEN 15 WHEN 4 THEN 3 WHEN 5 THEN 7 END AS day, CASE id % 6 WHEN 2 THEN 'ABT' WHEN 4 THEN 'BET' WHEN 5 THEN 'BEF' END AS modifier FROM persons)
SELECT id, year, month, day, CASE WHEN day IS NOT NULL THEN 2 WHEN month IS NOT NULL THEN 1 ELSE 0 END AS precision, modifier, year || CASE WHEN month IS NULL THEN '' ELSE '-' || lpad(month::VARCHAR, 2, '0') END || CASE WHEN day IS NULL THEN '' ELSE '-' || lpad(day::VARCHAR, 2, '0') END AS form FROM dt"""
#: A date of each side: years apart by the id, months and days known by its remainders.
DATE_PAIR = {
    "ya": "birth_year", "yb": "birth_year + CAST(MOD(id, 13) AS INT)", "ma": "CASE WHEN MOD(id, 4) > 0 THEN CAST(MOD(id, 3) + 1 AS INT) END", "mb": "CASE WHEN MOD(id, 5) > 0 THEN CAST(MOD(blk, 3) + 1 AS INT) END",
    "da": "CASE WHEN MOD(id, 4) > 1 THEN CAST(MOD(id, 2) + 1 AS INT) END", "db": "CASE WHEN MOD(id, 5) > 1 THEN CAST(MOD(blk, 2) + 1 AS INT) END",
}


def q_date_compare(spark, d):
    r = fixture.persons(spark, d).selectExpr("id", *[f"{x} AS {c}" for c, x in DATE_PAIR.items()])
    precision = lambda m, x: F.when(F.col(x).isNotNull(), 2).when(F.col(m).isNotNull(), 1).otherwise(0)
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return r.select("id", dates.similarity(F.col("ya"), F.col("yb"), precision("ma", "da"), precision("mb", "db"), same("ma", "mb"), same("da", "db")).alias("similarity"))


DATE_COMPARE_SQL = f""", dp AS (SELECT id, {', '.join(f'{x} AS {c}' for c, x in DATE_PAIR.items())} FROM persons)
SELECT id, CASE WHEN yb - ya = 0 THEN CASE WHEN ma IS NULL OR mb IS NULL THEN 0.9 WHEN ma <> mb THEN 0.85 WHEN da = db THEN 1.0 ELSE 0.95 END WHEN yb - ya = 1 THEN 0.8 WHEN yb - ya = 2 THEN 0.6 WHEN yb - ya <= 5 THEN 0.4 WHEN yb - ya <= 10 THEN 0.2 ELSE 0.0 END::DOUBLE AS similarity FROM dp"""

ID_FORMS = {"gedcom": "CONCAT('@I', id, '@')", "bare": "CONCAT(' I', id, ' ')", "geni": "CONCAT('geni:', id)", "profile": "CONCAT('profile-g', id)", "address": "CONCAT('https://www.geni.com/api/profile-', id)", "guid": "CONCAT('6000000000', LPAD(CAST(id AS {text}), 9, '0'))", "none": "CONCAT('@Ix', id)"}


def q_ids(spark, d):
    src = fixture.source(spark, d)
    rows = src.selectExpr("id", "explode(array(" + ", ".join(f"named_struct('form', '{k}', 'value', {x.format(text='STRING')})" for k, x in ID_FORMS.items()) + ")) AS e").select("id", "e.*")
    return rows.select("id", "form", names.gedcom_id(F.col("value")).alias("gedcom"), names.numeric_id(F.col("value")).alias("numeric_id"), names.profile_id(F.col("value")).alias("profile"), names.is_guid(F.col("value")).alias("guid"))


def _ids_sql() -> str:
    want = {
        "gedcom": ("'@I' || id || '@'", "id", "'@I' || id || '@'"), "bare": ("'@I' || id || '@'", "id", "'I' || id"), "geni": ("'@geni:' || id || '@'", "id", "'geni:' || id"), "profile": ("'@profile-g' || id || '@'", "id", "id"),
        "address": ("'@https://www.geni.com/api/profile-' || id || '@'", "NULL", "id"), "guid": ("'@' || v || '@'", "v", "v"), "none": ("'@Ix' || id || '@'", "NULL", "'@Ix' || id"),
    }
    return " UNION ALL ".join(f"SELECT id, '{k}' AS form, {g} AS gedcom, ({n})::VARCHAR AS numeric_id, ({p})::VARCHAR AS profile, {str(k == 'guid').lower()} AS guid FROM (SELECT id, {ID_FORMS[k].format(text='VARCHAR')} AS v FROM src)" for k, (g, n, p) in want.items())


def q_thresholds(spark, d):
    """Thresholds for as many candidates as the source's families have children, beside those of no child."""
    n = family.families(fixture.source(spark, d)).select(F.size("child_ids").alias("n")).union(spark.range(11).selectExpr("CAST(id AS INT)")).distinct()
    rows = n.crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in ("Parent", "Spouse", "Child", "Sibling", "Anchor")], "relation string")))
    return rows.select("relation", F.col("n").cast("int").alias("n"), *[family.threshold(F.col("relation"), F.col("n"), s).alias(s) for s in family.STRATEGY])


def q_variants(spark, d):
    """Which given names of the two trees the dictionary links."""
    p = fixture.persons(spark, d)
    known = variants.builtin(spark)
    low = lambda c: p.select(F.lower(c).alias(c)).distinct()
    return low("src_first").join(F.broadcast(known), F.col("src_first") == F.col("a")).join(low("dst_first"), F.col("dst_first") == F.col("b")).select("src_first", "dst_first")


def queries() -> dict:
    c = F.col
    return {
        "branch_plan": q_branch,
        "union_choice": q_unions,
        "repair_frontier": q_repair,
        "photo_mean_hash": q_mean_hash,
        "photo_near": lambda s, d: photohash.near_images(_hashes(s, d)),
        "gedcom_people": q_gedcom,
        "date_parse": q_dates,
        "date_compare": q_date_compare,
        "id_normalize": q_ids,
        "thresholds": q_thresholds,
        "variants_equiv": q_variants,
        "translit_normalize": lambda s, d: _names(s, d).select("name", names.transliterate(c("name")).alias("latin"), names.normalize(c("name")).alias("normal"), names.comparison_form(c("name")).alias("form"), names.normalize_place(c("name")).alias("place")),
        "script_detect": lambda s, d: _names(s, d).select("name", names.script(c("name")).alias("script"), names.is_ukrainian(c("name")).alias("ukrainian")),
        "namefix_special": lambda s, d: _names(s, d).select("name", names.clean_special(c("name")).alias("fixed")),
        "romanised": lambda s, d: _names(s, d).select("name", locales.romanise(c("name")).alias("latin"), locales.is_basic_latin(c("name")).alias("basic"), names.is_purely(c("name"), "Cyrillic").alias("cyrillic")),
        "surname_bases": lambda s, d: _surnames(s, d).select(c("name").alias("surname"), locales.surname_base(c("name")).alias("base")),
        "place_locales": lambda s, d: _names(s, d).select(c("name").alias("place"), locales.place_locale(c("name")).alias("locale")),
    }


def oracle_sql() -> dict[str, str]:
    o = fixture.oracle
    return {
        "branch_plan": o(_branch_sql()),
        "union_choice": o(UNIONS_SQL),
        "repair_frontier": o(REPAIR_SQL),
        "photo_mean_hash": f"WITH {HASH_SQL} SELECT id, {SIGNATURE_SQL} AS signature, {HASH_NUMBER_SQL} AS hash FROM h",
        "photo_near": f"WITH {HASH_SQL}, p AS (SELECT a.id, b.id AS other, len(list_filter(range(1, 65), lambda i: a.s[i] <> b.s[i])) AS n FROM h a JOIN h b ON a.id < b.id) SELECT id, other, 1 - n / 64 AS similarity FROM p WHERE n <= {photohash.MOST}",
        "gedcom_people": o(GED_SQL),
        "date_parse": o(DATES_SQL),
        "date_compare": o(DATE_COMPARE_SQL),
        "id_normalize": o(_ids_sql()),
        "thresholds": o(", " + THRESHOLDS_SQL.removeprefix("WITH ").replace("range(0, 11) s(n)", "(SELECT count(*) AS n FROM src WHERE father_id IS NOT NULL OR mother_id IS NOT NULL GROUP BY father_id, mother_id UNION SELECT unnest(range(0, 11))) s(n)")),
        "variants_equiv": o(f", {EDGES_SQL} SELECT DISTINCT lower(a.src_first) AS src_first, lower(b.dst_first) AS dst_first FROM (SELECT DISTINCT src_first FROM persons) a, (SELECT DISTINCT dst_first FROM persons) b, v WHERE v.a = lower(a.src_first) AND v.b = lower(b.dst_first)"),
        "translit_normalize": f"WITH {NAMES_SQL} SELECT name, {translit_sql('name')} AS latin, {norm_sql('name')} AS normal, trim(translate(lower({translit_sql('name')}), '-''.', '')) AS form, trim(replace(replace(lower(name), '.', ''), '-', ' ')) AS place FROM n",
        "script_detect": f"WITH {NAMES_SQL} SELECT name, {script_sql('name')} AS script, regexp_matches(name, '{SCRIPT_RANGES['Cyrillic']}') AND (regexp_matches(name, '[іїєґІЇЄҐ]') OR regexp_matches(lower(name), '{names.UKRAINIAN_ENDINGS}')) AS ukrainian FROM n",
        "romanised": f"WITH {NAMES_SQL} SELECT name, {roman_sql('name')} AS latin, NOT regexp_matches(name, '[^\\x00-\\x7F]') AS basic, {script_sql('name')} = 'Cyrillic' AS cyrillic FROM n",
        "surname_bases": o(f"{SURNAMES_SQL} SELECT name AS surname, {surname_sql('name')} AS base FROM m"),
        "place_locales": f"WITH {NAMES_SQL} SELECT name AS place, {place_sql('name')} AS locale FROM n",
    }

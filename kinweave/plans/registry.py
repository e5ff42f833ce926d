"""All queries of the linkage engine and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, names, similarity, variants
from ..operators import diff, family, graph, linkage, locale_model, namefix, photos, report, wave
from ..scratch import Scratch
from . import fixture

SINGLE, SEVERAL, SILENT = names.SINGLE, names.SEVERAL, names.SILENT


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of all documents."""
    return _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word")).distinct()


WORDS_SQL = r"w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents)"


def translit_sql(c: str) -> str:
    for letter, latin in SEVERAL.items():
        c = f"replace(replace({c}, '{letter}', '{latin}'), '{letter.upper()}', '{latin.capitalize()}')"
    ones = "".join(SINGLE)
    return f"translate({c}, '{ones + ones.upper() + SILENT + SILENT.upper()}', '{''.join(SINGLE.values()) + ''.join(SINGLE.values()).upper()}')"


def norm_sql(c: str) -> str:
    return f"nullif(translate(lower({translit_sql(c)}), '-''. ', ''), '')"


def jw_sql(a: str, b: str) -> str:
    """The library's formula on top of the engine's Jaro; for ASCII only."""
    prefix = f"coalesce(list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[i] = {b}[i]), false) - 1, least(length({a}), length({b})))"
    j = f"jaro_similarity({a}, {b})"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {j} > 0.7 THEN {j} + least(0.1, 1.0 / greatest(length({a}), length({b}))) * {prefix} * (1 - {j}) ELSE {j} END"


EDGES_SQL = "v(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in variants.edges()) + ")"
NAMES = ["Иван", "Maria", "Пётр", "Щукин-Ёлкин", "O'Connor", " Marie ", "Müller", "Weiß", "Żółty", "Søren", "Šimkus", "Mägi", "Шевченко", "שלום", "Привет Hello", "123 !@#", "Чайковский", "JOHN SMITH", "anna-maria", "Dr. John", "*12 [Bob]  Ray?", "Попов", "Sidorov", "Ковальчук", "Їжак"]
NAMES_SQL = "n(name) AS (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in NAMES) + ")"
DATES = ["15 JAN 1990", "JAN 1990", "1990", "BET 1900 AND 1910", "31 FEB 2000", "ABT 1850", "BEF 3 мая 1812", "29 FEB 2000", "x"]
IDS = ["I1", "@I1", "I1@", " I1 ", "F456", "@I123@", "geni:456", "profile-789", "invalid", "@Iabc@", "https://www.geni.com/api/profile-g34828568625", "6000000012345678901"]


def _values(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in values], f"{name} string")


def _trees(spark, d):
    return fixture.source(spark, d), fixture.target(spark, d)


def _same_id(spark, d) -> DataFrame:
    """Everyone who is in both trees, as a mapping."""
    return fixture.target(spark, d).select(F.col("id").alias("src_id"), F.col("id").alias("dst_id"), F.lit(80.0).alias("score"))


def kin_sql(n: str) -> str:
    """1, 0.5 or 0 for a relative of both sides by (first, last); a side without the relative, or without its names, gives 0."""
    first, last = jw_sql(f"s{n}f", f"d{n}f"), jw_sql(f"s{n}l", f"d{n}l")
    both = f"(({first}) + ({last})) / 2"
    return f"CASE WHEN s{n}f IS NULL OR d{n}f IS NULL OR ({first}) < 0.8 THEN 0.0 WHEN s{n}l IS NULL OR d{n}l IS NULL THEN CASE WHEN ({first}) >= 0.9 THEN 1.0 ELSE 0.5 END WHEN {both} >= 0.85 THEN 1.0 WHEN {both} >= 0.7 THEN 0.5 ELSE 0.0 END"


def _side_sql(p: str, tree: str) -> str:
    parent = lambda n, c: f"LEFT JOIN (SELECT id AS {p}{n}i, {norm_sql('first')} AS {p}{n}f, {norm_sql('last')} AS {p}{n}l FROM {tree}) {n} ON {n}.{p}{n}i = t.{c}"
    return f"SELECT t.id AS {p}id, lower(first) AS {p}raw, {norm_sql('first')} AS {p}a, {norm_sql('last')} AS {p}b, gender AS {p}g, birth_year AS {p}y, father_id AS {p}fa, mother_id AS {p}mo, {p}ff, {p}fl, {p}mf, {p}ml, {p}fi IS NOT NULL AS {p}fk, {p}mi IS NOT NULL AS {p}mk FROM {tree} t {parent('f', 'father_id')} {parent('m', 'mother_id')}"


def _parent_sql(n: str, c: str) -> str:
    """Agreement of a parent: by names where both trees hold it, else by id; null where neither side has one."""
    return f"CASE WHEN s{c} IS NULL AND d{c} IS NULL THEN NULL WHEN s{c} IS NULL OR d{c} IS NULL THEN 0.0 WHEN s{n}k AND d{n}k THEN k{n} WHEN s{c} = d{c} THEN 1.0 ELSE 0.0 END"


PAIRS_SQL = f"""
, {EDGES_SQL}, s AS MATERIALIZED ({_side_sql('s', 'src')}), d AS MATERIALIZED ({_side_sql('d', 'dst')}),
n AS MATERIALIZED (
  SELECT *, {jw_sql('x', 'y')} AS j FROM (SELECT DISTINCT s.sa AS x, d.da AS y FROM s, d) UNION SELECT *, {jw_sql('x', 'y')} FROM (SELECT DISTINCT s.sb AS x, d.db AS y FROM s, d)
), eq AS MATERIALIZED (SELECT DISTINCT sraw, sa, draw, da FROM (SELECT DISTINCT sraw, sa FROM s), (SELECT DISTINCT draw, da FROM d) WHERE EXISTS (SELECT 1 FROM v WHERE (v.a = sraw AND v.b = draw) OR (v.a = sa AND v.b = da))),
q AS MATERIALIZED (
  SELECT s.*, d.*, f.j AS fj, l.j AS lj, eq.sa IS NOT NULL AS known, abs(sy - dy) AS gap,
    sg = dg OR sg = 'Unknown' OR dg = 'Unknown' AS same
  FROM s JOIN d ON NOT (sg <> 'Unknown' AND dg <> 'Unknown' AND sg <> dg) AND NOT coalesce(abs(sy - dy) > 15, false)
  JOIN n f ON f.x = s.sa AND f.y = d.da JOIN n l ON l.x = s.sb AND l.y = d.db
  LEFT JOIN eq ON eq.sraw = s.sraw AND eq.sa = s.sa AND eq.draw = d.draw AND eq.da = d.da
), o AS MATERIALIZED (
  SELECT *, CASE WHEN sa = da THEN 1.0 WHEN known THEN 0.95 WHEN (contains(sa, da) OR contains(da, sa)) AND fj > 0.7 THEN greatest(fj, 0.85) ELSE fj END * 25 + lj * 20
    + CASE WHEN gap IS NULL THEN 0.0 WHEN gap = 0 THEN 0.9 WHEN gap = 1 THEN 0.8 WHEN gap <= 2 THEN 0.6 WHEN gap <= 5 THEN 0.4 WHEN gap <= 10 THEN 0.2 ELSE 0.0 END * 15 + 2 AS points,
    CASE WHEN gap IS NULL THEN 72.0 ELSE 87.0 END AS most FROM q
), kk AS (SELECT *, {kin_sql('f')} AS kf, {kin_sql('m')} AS km FROM o WHERE 100 * (points + 25) / most + 20 >= 45),
w AS (SELECT *, {_parent_sql('f', 'fa')} AS pf, {_parent_sql('m', 'mo')} AS pm FROM kk),
h AS (
  SELECT *, CASE WHEN pf IS NULL AND pm IS NULL THEN 0.0 ELSE coalesce((coalesce(pf, 0.0) + coalesce(pm, 0.0)) / ((pf IS NOT NULL)::INT + (pm IS NOT NULL)::INT), 0.0) END AS family,
    coalesce(sfk AND dfk AND smk AND dmk AND kf >= 0.8 AND km >= 0.8, false) AS parents FROM w
), r AS (SELECT sid AS src_id, did AS dst_id, family, 100 * (points + 25 * family) / most + CASE WHEN parents THEN 10 ELSE 0 END AS raw FROM h),
g AS (SELECT src_id, dst_id, least(100.0, CASE WHEN family < 0.1 AND raw > 85 THEN 85.0 ELSE raw END) AS score FROM r)"""
#: The least score of a best match, and of the pairs in pair_scores, top_matches and exclusivity.
FOUND, SURE = 80, 97


def q_pair_scores(spark, d):
    return linkage.found_counts(*_trees(spark, d), SURE).withColumn("best", F.round("best", 6))


def q_top(spark, d):
    return linkage.found_top(*_trees(spark, d), SURE, 3, 6)


def q_exclusivity(spark, d):
    """Those whose source has no better candidate, nor one as good: the first two tell."""
    return linkage.exclusivity(linkage.found_top(*_trees(spark, d), SURE, 2).drop("rank")).where("exclusivity > 0")


def q_bfs(spark, d):
    return graph.bfs(fixture.source(spark, d), 0, 4)


def q_structure(spark, d):
    src, dst = _trees(spark, d)
    return family.structure_scores(family.families(src), family.families(dst), _same_id(spark, d).where("src_id % 3 <> 1"))


def _in_blocks(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Pairs within a block of seven of the fixture."""
    blk = F.floor(F.col("id") / 7).alias("blk")
    return src.select(F.col("id").alias("src_id"), blk).join(dst.select(F.col("id").alias("dst_id"), blk), "blk").select("src_id", "dst_id")


def q_assignment(spark, d):
    scratch = Scratch(spark, "assignment")
    src, dst = (scratch.keep(x, "tree") for x in _trees(spark, d))
    pairs = linkage.scored_pairs(src, dst, _in_blocks(src, dst)).withColumn("family", F.floor(F.col("src_id") / 7))
    return family.assign(pairs).select("family", "src_id", "dst_id", F.round("score", 6).alias("score"))


def q_validate(spark, d):
    src, dst = _trees(spark, d)
    mapping = _same_id(spark, d).select("src_id", F.when(F.col("src_id") % 4 == 0, F.col("src_id") + 1).otherwise(F.col("dst_id")).alias("dst_id"), F.when(F.col("src_id") % 6 == 0, 30.0).otherwise(80.0).alias("score"))
    return family.validate(mapping, src, dst)


VALIDATE_SQL = """, m AS (SELECT id AS src_id, CASE WHEN id % 4 = 0 THEN id + 1 ELSE id END AS dst_id, CASE WHEN id % 6 = 0 THEN 30.0 ELSE 80.0 END AS score FROM dst),
f AS (SELECT dst_id, min(src_id) AS first FROM m GROUP BY 1),
x AS (SELECT m.*, f.first, s.id AS sid, d.id AS did, s.gender AS sg, d.gender AS dg, abs(s.birth_year - d.birth_year) AS gap FROM m JOIN f USING (dst_id) LEFT JOIN src s ON s.id = m.src_id LEFT JOIN dst d ON d.id = m.dst_id)
SELECT src_id, dst_id, 'unknown_id' AS issue, 'High' AS severity FROM x WHERE sid IS NULL OR did IS NULL
UNION ALL SELECT src_id, dst_id, 'gender', 'High' FROM x WHERE sg <> 'Unknown' AND dg <> 'Unknown' AND sg <> dg
UNION ALL SELECT src_id, dst_id, 'birth_year', 'High' FROM x WHERE gap > 15
UNION ALL SELECT src_id, dst_id, 'birth_year', 'Medium' FROM x WHERE gap > 5 AND gap <= 15
UNION ALL SELECT src_id, dst_id, 'duplicate_destination', 'High' FROM x WHERE src_id <> first
UNION ALL SELECT src_id, dst_id, 'low_score', 'Medium' FROM x WHERE score < 40"""

REL_SQL = """, up AS (SELECT DISTINCT c.id AS child, p.id AS parent FROM src c JOIN src p ON p.id IN (c.father_id, c.mother_id)),
cp AS (SELECT DISTINCT father_id AS a, mother_id AS b FROM src WHERE father_id IN (SELECT id FROM src) AND mother_id IN (SELECT id FROM src)),
sib AS (SELECT a.id, b.id AS other FROM src a JOIN src b ON coalesce(a.father_id, -1) = coalesce(b.father_id, -1) AND coalesce(a.mother_id, -1) = coalesce(b.mother_id, -1) AND a.id <> b.id WHERE a.father_id IS NOT NULL OR a.mother_id IS NOT NULL),
rel AS (SELECT child AS id, 'parent' AS relation, parent AS other FROM up UNION ALL SELECT parent, 'child', child FROM up UNION ALL SELECT a, 'spouse', b FROM cp UNION ALL SELECT b, 'spouse', a FROM cp UNION ALL SELECT id, 'sibling', other FROM sib)"""

SCRIPT_RANGES = {"Latin": "[A-Za-zÀ-ÿĀ-ɏḀ-ỿ]", "Cyrillic": "[\\x{0400}-\\x{052F}]", "Hebrew": "[\\x{0590}-\\x{05FF}]", "Arabic": "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}]", "Greek": "[\\x{0370}-\\x{03FF}\\x{1F00}-\\x{1FFF}]"}


def script_sql(c: str) -> str:
    flags = {k: f"regexp_matches({c}, '{p}')::INT" for k, p in SCRIPT_RANGES.items()}
    total = " + ".join(flags.values())
    return f"CASE WHEN {total} = 0 THEN 'Unknown' WHEN {total} > 1 THEN 'Mixed' " + " ".join(f"WHEN {f} = 1 THEN '{k}'" for k, f in flags.items()) + " END"


def latin_sql(c: str) -> str:
    low = f"lower({c})"
    tests = ((names.LITHUANIAN, "lt"), (names.ESTONIAN, "et"), (names.LATVIAN, "lv"), (names.POLISH, "pl"))
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{p}') THEN '{k}'" for p, k in tests) + f" WHEN regexp_matches({low}, 'ß') OR (regexp_matches({low}, '[äöü]') AND regexp_matches({low}, '{names.GERMAN_PARTS}')) THEN 'de' ELSE 'en' END"


def q_thresholds(spark, d):
    rel = spark.createDataFrame([(r,) for r in ("Parent", "Spouse", "Child", "Sibling", "Anchor")], "relation string")
    rows = rel.select("relation", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("n"))
    return rows.select("relation", F.col("n").cast("int").alias("n"), *[family.threshold(F.col("relation"), F.col("n"), s).alias(s) for s in family.STRATEGY])


THRESHOLDS_SQL = "WITH t AS (SELECT relation, n::INT AS n, CASE relation WHEN 'Parent' THEN 55 WHEN 'Spouse' THEN 55 WHEN 'Child' THEN 50 WHEN 'Sibling' THEN 60 ELSE 100 END + CASE WHEN n = 1 THEN -5 WHEN n = 2 THEN 0 WHEN n IN (3, 4) THEN 5 WHEN n BETWEEN 5 AND 8 THEN 10 ELSE 15 END AS b FROM (VALUES ('Parent'), ('Spouse'), ('Child'), ('Sibling'), ('Anchor')) r(relation), range(0, 11) s(n)) SELECT relation, n, greatest(least(b, 85), 30)::INT AS adaptive, greatest(least(b - 10, 85), 30)::INT AS aggressive, greatest(least(b + 15, 85), 30)::INT AS conservative FROM t"


def q_child_score(spark, d):
    p = fixture.source(spark, d)
    a = p.where("r is null") if "r" in p.columns else p
    pairs = a.select("id", F.col("birth_year").alias("y"), "gender", F.floor(F.col("id") / 7).alias("b")).alias("a").join(fixture.target(spark, d).select(F.col("id").alias("other"), F.col("birth_year").alias("oy"), F.col("gender").alias("og"), F.floor(F.col("id") / 7).alias("b")), "b")
    clash = (F.col("gender") != "Unknown") & (F.col("og") != "Unknown") & (F.col("gender") != F.col("og"))
    return pairs.select("id", "other", family.child_score(F.lit(71.0), F.col("id"), F.col("other"), F.col("y"), F.col("oy"), clash).alias("score"))


CHILD_SQL = "SELECT a.id, b.id AS other, CASE WHEN a.gender <> 'Unknown' AND b.gender <> 'Unknown' AND a.gender <> b.gender THEN 0 ELSE least(100, 15 + 42 + CASE WHEN abs(a.id - b.id) <= 1 THEN 10 WHEN abs(a.id - b.id) = 2 THEN 5 ELSE 0 END + CASE WHEN abs(a.birth_year - b.birth_year) = 0 THEN 15 WHEN abs(a.birth_year - b.birth_year) <= 2 THEN 10 WHEN abs(a.birth_year - b.birth_year) <= 5 THEN 5 ELSE 0 END) END::INT AS score FROM src a JOIN dst b ON floor(a.id / 7.0) = floor(b.id / 7.0)"


def q_field_diffs(spark, d):
    src, dst = _trees(spark, d)
    src = src.withColumn("place", F.when(F.col("id") % 2 == 0, "Kyiv"))
    dst = dst.withColumn("birth_year", F.when(F.col("id") % 3 != 0, F.col("birth_year"))).withColumn("place", F.when(F.col("id") % 4 == 0, "Kyiv"))
    return diff.added_fields(src, dst, _same_id(spark, d), ["first", "last", "gender", "birth_year", "place"])


FIELD_SQL = """, m AS (SELECT a.id, a.birth_year::VARCHAR AS sy, CASE WHEN b.id % 3 <> 0 THEN b.birth_year END AS dy, CASE WHEN a.id % 2 = 0 THEN 'Kyiv' END AS sp, CASE WHEN b.id % 4 = 0 THEN 'Kyiv' END AS dp FROM src a JOIN dst b ON a.id = b.id)
SELECT id AS src_id, id AS dst_id, 'birth_year' AS field, sy AS new_value, 'Add' AS action FROM m WHERE dy IS NULL AND sy IS NOT NULL
UNION ALL SELECT id, id, 'place', sp, 'Add' FROM m WHERE sp IS NOT NULL AND dp IS NULL"""


def q_photo_hamming(spark, d):
    h = photos.sign_hashes(_table(spark, d, "embeddings"))
    a, b = h.select(F.col("vec_id").alias("a"), F.col("hash").alias("ha"), (F.col("vec_id") + 1).alias("b")), h.select(F.col("vec_id").alias("b"), F.col("hash").alias("hb"))
    return a.join(b, "b").select("a", "b", similarity.hash_similarity(F.col("ha"), F.col("hb")).alias("similarity"))


HAMMING_SQL = "WITH h AS (SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS s FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, 1 - len(list_filter(range(1, 65), lambda i: a.s[i] <> b.s[i])) / 64 AS similarity FROM h a JOIN h b ON b.vec_id = a.vec_id + 1"


def q_wave(spark, d):
    src, dst = _trees(spark, d)
    return wave.align(src, dst, None, spark.createDataFrame([(0, 0)], "src_id long, dst_id long"))


def q_relations(spark, d):
    src, dst = _trees(spark, d)
    mapping = _same_id(spark, d)
    return report.relations(family.unmatched(src, mapping, "src_id"), graph.relatives(src), mapping)


RELATIONS_SQL = """, q AS (
  SELECT r.id, r.other, CASE r.relation WHEN 'spouse' THEN 0 WHEN 'parent' THEN 1 WHEN 'child' THEN 2 ELSE 3 END AS k, CASE r.relation WHEN 'spouse' THEN 'Spouse' WHEN 'parent' THEN 'Child' WHEN 'child' THEN 'Parent' ELSE 'Sibling' END AS relation
  FROM rel r WHERE r.id NOT IN (SELECT id FROM dst) AND r.other IN (SELECT id FROM dst)
), z AS (SELECT *, min(k) OVER (PARTITION BY id) AS best FROM q)
SELECT id AS src_id, relation, other, other AS dst_id, row_number() OVER (PARTITION BY id ORDER BY k, other)::INT AS rank FROM z WHERE k < 3 OR best = 3"""


def q_level_stats(spark, d):
    return q_wave(spark, d).groupBy("level").agg(F.count("*").alias("n_mapped"), F.count_if(F.col("found_via") == "Child").alias("n_children"))


def queries() -> dict:
    src = fixture.source
    return {
        "link_best_match": lambda s, d: linkage.best_matches(*_trees(s, d), FOUND),
        "pair_scores": q_pair_scores,
        "top_matches": q_top,
        "exclusivity": q_exclusivity,
        "persons_fixture": lambda s, d: fixture.persons(s, d),
        "tree_stats": lambda s, d: graph.stats(src(s, d)),
        "relatives_1hop": lambda s, d: graph.relatives(src(s, d)),
        "relatives_2deg": lambda s, d: graph.within_two(src(s, d)),
        "siblings_exact": lambda s, d: graph.siblings(src(s, d)),
        "siblings_any": lambda s, d: graph.siblings(src(s, d), "any"),
        "bfs_depth": q_bfs,
        "families": lambda s, d: family.families(src(s, d)).select("husband_id", "wife_id", F.size("child_ids").cast("long").alias("n_children")),
        "family_structure_score": q_structure,
        "thresholds": q_thresholds,
        "child_score": q_child_score,
        "child_assignment": q_assignment,
        "validate_mappings": q_validate,
        "transitive_issues": lambda s, d: family.broken_links(_same_id(s, d), graph.relatives(src(s, d)), graph.relatives(fixture.target(s, d).withColumn("mother_id", F.when(F.col("id") % 4 != 0, F.col("mother_id"))))).where("relation <> 'sibling'"),
        "add_relations": q_relations,
        "add_plan": lambda s, d: report.additions(q_relations(s, d), src(s, d)),
        "mapping_bands": lambda s, d: report.bands(q_wave(s, d)).groupBy("band").agg(F.count("*").alias("n")),
        "training_rows": lambda s, d: locale_model.training_rows(src(s, d)),
        "wave_mappings": q_wave,
        "level_stats": q_level_stats,
        "unmatched": lambda s, d: family.unmatched(src(s, d), _same_id(s, d), "src_id"),
        "field_diffs": q_field_diffs,
        "update_payload": lambda s, d: diff.update_payload(q_field_diffs(s, d)),
        "photo_hamming": q_photo_hamming,
        "photo_source": lambda s, d: _table(s, d, "pages").select("page_id", names.photo_source(F.col("url")).alias("photo_source")),
        "translit_normalize": lambda s, d: _values(s, NAMES, "name").select("name", names.transliterate(F.col("name")).alias("latin"), names.normalize(F.col("name")).alias("normal"), names.comparison_form(F.col("name")).alias("form"), names.normalize_place(F.col("name")).alias("place")),
        "script_detect": lambda s, d: _values(s, NAMES, "name").select("name", names.script(F.col("name")).alias("script"), names.is_ukrainian(F.col("name")).alias("ukrainian")),
        "latin_language": lambda s, d: _words(s, d).select("word", names.latin_language(F.col("word")).alias("language")),
        "remove_diacritics": lambda s, d: _words(s, d).select("word", names.remove_diacritics(F.col("word")).alias("plain")),
        "variants_equiv": lambda s, d: variants.builtin(s).alias("x").join(variants.builtin(s).select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select(F.col("a"), "b", "c").where("a < c"),
        "id_normalize": lambda s, d: _values(s, IDS, "value").select("value", names.gedcom_id(F.col("value")).alias("gedcom"), names.numeric_id(F.col("value")).alias("numeric_id"), names.is_guid(F.col("value")).alias("guid")),
        "date_parse": lambda s, d: _values(s, DATES, "value").withColumn("p", dates.parse(F.col("value"))).select("value", "p.year", "p.month", "p.day", "p.precision", F.when(F.col("p").isNotNull(), dates.form(F.col("p"))).alias("form")),
        "date_compare": lambda s, d: s.range(0, 20).select(F.col("id"), dates.similarity(F.lit(1900), 1900 + F.col("id").cast("int"), F.lit(0), F.lit(2)).alias("similarity")),
        "namefix_special": lambda s, d: _values(s, NAMES, "name").select("name", names.clean_special(F.col("name")).alias("fixed")),
        "namefix_capitalization": lambda s, d: _words(s, d).where(F.col("word").rlike("^[A-Za-z]+$")).select("word", names.capitalize(F.col("word")).alias("fixed")),
        "namefix_feminine": lambda s, d: src(s, d).where("gender = 'Female'").select("id", names.feminine(F.col("last")).alias("fixed")),
        "namefix_changes": lambda s, d: namefix.changes(namefix.profiles(src(s, d))),
        "jaro_winkler": lambda s, d: similarity.with_similarity(_table(s, d, "supplier").selectExpr("s_suppkey", "lower(s_name) AS x").withColumn("y", F.lit("supplier#000000042")), "x", "y", "jw").select("s_suppkey", F.round("jw", 9).alias("jw")),
        "locale_histogram": lambda s, d: namefix.locale_histogram(src(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    o = fixture.oracle
    two = ", ".join(f"('{a}', '{b}')" for a, b in graph.TWO_STEPS)
    return {
        "link_best_match": o(PAIRS_SQL + f" SELECT src_id, dst_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY round(score, 6) DESC, dst_id) AS k FROM g WHERE score >= {FOUND}) WHERE k = 1"),
        "pair_scores": o(PAIRS_SQL + f" SELECT src_id, count(*) AS n_pairs, round(max(score), 6) AS best FROM g WHERE score >= {SURE} GROUP BY 1"),
        "top_matches": o(PAIRS_SQL + f" SELECT src_id, k::INT AS rank, dst_id, score FROM (SELECT src_id, dst_id, round(score, 6) AS score, row_number() OVER (PARTITION BY src_id ORDER BY round(score, 6) DESC, dst_id) AS k FROM g WHERE score >= {SURE}) WHERE k <= 3"),
        "exclusivity": o(PAIRS_SQL + f", e AS (SELECT src_id, dst_id, score, max(score) OVER w AS best, coalesce(nth_value(score, 2) OVER (PARTITION BY src_id ORDER BY score DESC, dst_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS second FROM g WHERE score >= {SURE} WINDOW w AS (PARTITION BY src_id)) SELECT src_id, dst_id, round((score - second) / best, 6) AS exclusivity FROM e WHERE round((score - second) / best, 6) > 0"),
        "persons_fixture": o("SELECT * FROM persons"),
        "tree_stats": o("SELECT count(*) AS n_persons, count(*) FILTER (gender = 'Male') AS n_male, count(*) FILTER (gender = 'Female') AS n_female, count(birth_year) AS n_birth, count(father_id) AS n_father FROM src"),
        "relatives_1hop": o(REL_SQL + " SELECT * FROM rel"),
        "relatives_2deg": o(REL_SQL + f", t(f, g) AS (VALUES {two}) SELECT x.id, y.other FROM rel x JOIN t ON t.f = x.relation JOIN rel y ON y.id = x.other AND y.relation = t.g UNION SELECT id, other FROM rel UNION SELECT id, id FROM src"),
        "siblings_exact": o(REL_SQL + " SELECT id, other FROM sib"),
        "siblings_any": o(REL_SQL + " SELECT DISTINCT a.child AS id, b.child AS other FROM up a JOIN up b ON a.parent = b.parent AND a.child <> b.child"),
        "bfs_depth": o(REL_SQL + ", b AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT r.other, b.depth + 1 FROM b JOIN rel r ON r.id = b.id WHERE b.depth < 4) SELECT id, min(depth)::INT AS depth FROM b GROUP BY 1"),
        "families": o("SELECT father_id AS husband_id, mother_id AS wife_id, count(*) AS n_children FROM src WHERE father_id IS NOT NULL OR mother_id IS NOT NULL GROUP BY ALL"),
        "thresholds": THRESHOLDS_SQL,
        "child_score": o(CHILD_SQL),
        "validate_mappings": o(VALIDATE_SQL),
        "add_relations": o(REL_SQL + RELATIONS_SQL),
        "unmatched": o("SELECT id FROM src WHERE id NOT IN (SELECT id FROM dst)"),
        "field_diffs": o(FIELD_SQL),
        "photo_hamming": HAMMING_SQL,
        "photo_source": "SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)(myheritage\\.com|myheritageimages\\.com)$') THEN 'myheritage' WHEN regexp_matches(h, '(^|\\.)geni\\.com$') THEN 'geni' ELSE 'other' END AS photo_source FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS h FROM pages)",
        "translit_normalize": f"WITH {NAMES_SQL} SELECT name, {translit_sql('name')} AS latin, {norm_sql('name')} AS normal, trim(translate(lower({translit_sql('name')}), '-''.', '')) AS form, trim(replace(replace(lower(name), '.', ''), '-', ' ')) AS place FROM n",
        "script_detect": f"WITH {NAMES_SQL} SELECT name, {script_sql('name')} AS script, regexp_matches(name, '[\\x{{0400}}-\\x{{052F}}]') AND (regexp_matches(name, '[іїєґІЇЄҐ]') OR regexp_matches(lower(name), '{names.UKRAINIAN_ENDINGS}')) AS ukrainian FROM n",
        "latin_language": f"WITH {WORDS_SQL} SELECT word, {latin_sql('word')} AS language FROM w",
        "variants_equiv": f"WITH {EDGES_SQL} SELECT x.a, x.b, y.b AS c FROM v x JOIN v y ON y.a = x.b WHERE x.a < y.b",
        "date_compare": "SELECT id, CASE WHEN id = 0 THEN 0.9 WHEN id = 1 THEN 0.8 WHEN id <= 2 THEN 0.6 WHEN id <= 5 THEN 0.4 WHEN id <= 10 THEN 0.2 ELSE 0.0 END::DOUBLE AS similarity FROM range(0, 20) t(id)",
        "namefix_capitalization": f"WITH {WORDS_SQL} SELECT word, CASE WHEN word = upper(word) OR word = lower(word) THEN upper(word[1]) || lower(word[2:]) ELSE word END AS fixed FROM w WHERE regexp_matches(word, '^[A-Za-z]+$')",
        "namefix_feminine": o("SELECT id, CASE WHEN regexp_matches(lower(last), '(ко|ых|их|ko|ykh|ikh)$') THEN last WHEN regexp_matches(lower(last), '[сц]кий$') THEN last[:-3] || 'ая' WHEN regexp_matches(lower(last), '(ов|ев|ин)$') THEN last || 'а' WHEN regexp_matches(last, 'iy$') THEN last[:-3] || 'aya' WHEN regexp_matches(last, '(ov|ev|in)$') THEN last || 'a' ELSE last END AS fixed FROM src WHERE gender = 'Female'"),
        "jaro_winkler": f"SELECT s_suppkey, round({jw_sql('x', 'y')}, 9) AS jw FROM (SELECT s_suppkey, lower(s_name) AS x, 'supplier#000000042' AS y FROM supplier)",
        "locale_histogram": o("SELECT CASE WHEN regexp_matches(first, '[\\x{0400}-\\x{052F}]') THEN 'ru' ELSE 'en' END AS locale, count(*) AS n FROM src GROUP BY 1"),
    }

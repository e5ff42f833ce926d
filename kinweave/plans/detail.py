"""Queries of the whole pair score, conflict resolution, locales and locale-wise name repair, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import locales, names
from ..operators import compare, graph, localenames, resolve
from ..scratch import Scratch
from . import fixture
from .registry import EDGES_SQL, NAMES, NAMES_SQL, WORDS_SQL, _trees, _values, _words, jw_sql, latin_sql, norm_sql, script_sql

SAMPLE_PLACES = ["Москва, Россия", "St. Petersburg", "Lviv, Ukraine", "Tel Aviv", "Köln am Rhein", "Łódź", "Гродно", "Kaunas", "Riga", "Brooklyn, NY", "Leeds", "Atlantis", "", "Vilnius, Russian Empire"]
SURNAMES = ["Чайковская", "ТРОЦКАЯ", "Красная", "Горькая", "Иванова", "Королёва", "Путина", "Лисицына", "Шевченко", "Полищук", "Kowalska", "NOWICKA", "Chaikovskaya", "Trotskaya", "Ivanova", "Сковорода", " Petrova ", "Smith", "", "Czerwona"]

#: Further columns of the fixture's people: maiden names, places, deaths, and some without a year of birth.
SRC_MORE = {
    "birth_year": "CASE WHEN MOD(id, 9) <> 0 THEN birth_year END", "maiden": "CASE WHEN gender = 'Female' AND MOD(id, 2) = 0 THEN 'Petrova' END",
    "birth_place": "CASE MOD(id, 4) WHEN 0 THEN 'Moscow' WHEN 1 THEN 'Moscow, Russia' WHEN 2 THEN 'Kiev, Ukraine' END", "death_year": "CASE WHEN MOD(id, 5) <> 1 THEN birth_year + 60 END",
}
DST_MORE = {
    "birth_year": "birth_year", "maiden": "CASE WHEN gender = 'Female' AND MOD(id, 4) <> 3 THEN CASE WHEN MOD(id, 4) = 1 THEN 'Petrowa' ELSE 'Ivanova' END END",
    "birth_place": "CASE MOD(id, 3) WHEN 0 THEN 'Moscow, Russia' WHEN 1 THEN 'Kiev region Ukraine' ELSE 'moscow' END", "death_year": "birth_year + 60 + MOD(id, 3)",
}


def _more(df: DataFrame, more: dict) -> DataFrame:
    """The fixture's people with the further columns and their relatives' ids."""
    rel = graph.relatives(df)
    ids = rel.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("relation") == k, F.col("other").cast("string")))).alias(f"{k}_ids") for k in ("spouse", "child", "sibling")])
    kept = [c for c in df.columns if c not in more]
    return df.selectExpr(*kept, *[f"{x} AS {c}" for c, x in more.items()]).join(ids, "id", "left")


def _pairs(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Pairs within a block of the fixture whose genders and years fit."""
    s = src.selectExpr("id AS src_id", "gender AS sg", "birth_year AS sy", "FLOOR(id / 7.0) AS blk")
    d = dst.selectExpr("id AS dst_id", "gender AS dg", "birth_year AS dy", "FLOOR(id / 7.0) AS blk")
    return s.join(d, "blk").where("NOT (sg <> 'Unknown' AND dg <> 'Unknown' AND sg <> dg) AND NOT coalesce(abs(sy - dy) > 15, false)").select("src_id", "dst_id")


def _fields(spark, d) -> DataFrame:
    """Trees, their relatives and people are written once each: a plan that makes them anew wherever they are read has dozens of copies of the fixture. So are pairs with all but the relatives."""
    scratch = Scratch(spark, "fields")
    src, dst = (scratch.keep(x, "tree") for x in _trees(spark, d))
    people = [scratch.keep(_more(df, more), "more") for df, more in ((src, SRC_MORE), (dst, DST_MORE))]
    left, right = (scratch.keep(compare.nameless(df), "people") for df in people)
    return compare.fields_of(_pairs(*people), left, right, scratch)


def q_pair_fields(spark, d):
    sims = [F.round(f"{c}_sim", 6).alias(f"{c}_sim") for c in ("first", "last", "maiden", "birth", "place", "death")]
    return _fields(spark, d).select(F.col("s_id").cast("long").alias("src_id"), F.col("d_id").cast("long").alias("dst_id"), *sims)


def q_full_scores(spark, d):
    return compare.scored(_fields(spark, d)).select(F.col("src_id").cast("long").alias("src_id"), F.col("dst_id").cast("long").alias("dst_id"), F.round("score", 6).alias("score"))


def q_resolved(spark, d):
    """A mapping whose every third target is a neighbour's, resolved among the targets' relatives within two steps."""
    scratch = Scratch(spark, "resolved")
    dst = scratch.keep(_trees(spark, d)[1], "tree")
    scores = q_full_scores(spark, d)
    known = dst.select(F.col("id").alias("dst_id"))
    mapping = dst.select(F.col("id").alias("src_id"), F.when(F.col("id") % 3 == 1, F.col("id") + 1).otherwise(F.col("id")).alias("dst_id"), F.lit(60).alias("score"), F.when(F.col("id") == 0, "Anchor").otherwise("Child").alias("found_via")).join(known, "dst_id", "left_semi")
    mapping = scratch.keep(mapping, "mapping")
    return resolve.resolve(mapping, graph.within_two(dst), scores).select("src_id", "dst_id", "score")


def _more_sql(table: str, more: dict) -> str:
    return f"SELECT id, first, last, gender, CAST(FLOOR(id / 7.0) AS BIGINT) AS blk, {', '.join(f'{x} AS {c}' for c, x in more.items())} FROM {table}"


def _event_sql(a: str, b: str) -> str:
    gap = f"abs({a} - {b})"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {gap} = 0 THEN 0.9 WHEN {gap} = 1 THEN 0.8 WHEN {gap} <= 2 THEN 0.6 WHEN {gap} <= 5 THEN 0.4 WHEN {gap} <= 10 THEN 0.2 ELSE 0.0 END::DOUBLE"


def pair_fields_sql() -> str:
    place = lambda c: f"trim(translate(replace(lower({c}), '.', ''), '-', ' '))"
    words = lambda c: f"list_distinct(list_filter(list_transform(regexp_split_to_array({c}, '[, ]'), lambda t: trim(t)), lambda t: length(t) > 2))"
    form = lambda c: f"trim(translate(lower({c}), '-''.', ''))"
    side = lambda t, more: f"SELECT *, {norm_sql('first')} AS nf, {norm_sql('last')} AS nl, {form('maiden')} AS nm, {place('birth_place')} AS np FROM ({_more_sql(t, more)})"
    return fixture.oracle(f""", {EDGES_SQL}, s AS ({side('src', SRC_MORE)}), d AS ({side('dst', DST_MORE)}),
c AS (SELECT s.id AS src_id, d.id AS dst_id, s.nf AS fa, d.nf AS fb, s.nl AS la, d.nl AS lb, s.nm AS ma, d.nm AS mb, s.np AS pa, d.np AS pb, s.birth_year AS sb, d.birth_year AS db, s.death_year AS sd, d.death_year AS dd,
  EXISTS (SELECT 1 FROM v WHERE (v.a = lower(s.first) AND v.b = lower(d.first)) OR (v.a = s.nf AND v.b = d.nf)) AS known
  FROM s JOIN d ON s.blk = d.blk AND NOT (s.gender <> 'Unknown' AND d.gender <> 'Unknown' AND s.gender <> d.gender) AND NOT coalesce(abs(s.birth_year - d.birth_year) > 15, false)),
j AS (SELECT *, {jw_sql('fa', 'fb')} AS fj, {jw_sql('la', 'lb')} AS lj, {jw_sql('ma', 'mb')} AS mj, {words('pa')} AS wa, {words('pb')} AS wb FROM c)
SELECT src_id, dst_id, round(CASE WHEN fa = fb THEN 1.0 WHEN known THEN 0.95 WHEN (contains(fa, fb) OR contains(fb, fa)) AND fj > 0.7 THEN greatest(fj, 0.85) ELSE fj END, 6)::DOUBLE AS first_sim,
  round(CASE WHEN la = lb THEN 1.0 WHEN ma = lb OR mb = la THEN 0.95 ELSE lj END, 6)::DOUBLE AS last_sim,
  round(CASE WHEN ma IS NULL OR mb IS NULL THEN NULL WHEN ma = mb THEN 1.0 ELSE mj END, 6)::DOUBLE AS maiden_sim, {_event_sql('sb', 'db')} AS birth_sim,
  round(CASE WHEN pa IS NULL OR pb IS NULL THEN NULL WHEN pa = pb THEN 1.0 WHEN contains(pa, pb) OR contains(pb, pa) THEN 0.8 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END, 6)::DOUBLE AS place_sim, {_event_sql('sd', 'dd')} AS death_sim FROM j""")


def place_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{parts.replace('.', chr(92) + '.')}') THEN '{locale}'" for locale, parts in locales.PLACES) + " END"


def surname_sql(c: str) -> str:
    t = f"trim({c})"
    man = lambda w, m: t if w == m else f"left({t}, length({t}) - {len(w)}) || CASE WHEN right({t}, {len(w)}) = upper(right({t}, {len(w)})) THEN '{m.upper()}' ELSE '{m}' END"
    unchanged = ", ".join(f"'{x}'" for x in locales.UNCHANGED)
    return f"CASE WHEN {t} = '' THEN '' WHEN lower({t}) IN ({unchanged}) THEN {t} " + " ".join(f"WHEN ends_with(lower({t}), '{w}') THEN {man(w, m)}" for w, m in locales.ENDINGS) + f" ELSE {t} END"


def roman_sql(c: str) -> str:
    for letter, latin in locales.ROMAN_SEVERAL.items():
        c = f"replace(replace({c}, '{letter}', '{latin}'), '{letter.upper()}', '{latin.capitalize()}')"
    ones, latin = "".join(locales.ROMAN_SINGLE), "".join(locales.ROMAN_SINGLE.values())
    return f"translate({c}, '{ones + ones.upper() + names.SILENT + names.SILENT.upper()}', '{latin + latin.upper()}')"


def _profiles(spark, d, build: dict[str, dict[str, str]]) -> DataFrame:
    """The fixture's people as profiles with names of the given SQL expressions by locale and field, and no values of their own."""
    inner = lambda fields: "map(" + ", ".join(f"'{f}', {x}" for f, x in fields.items()) + ")"
    text = "map(" + ", ".join(f"'{loc}', {inner(fields)}" for loc, fields in build.items()) + ")"
    none = [f"CAST(NULL AS STRING) AS {c}" for c in ("first", "middle", "last", "maiden", "suffix")]
    return fixture.persons(spark, d).selectExpr("id", f"{text} AS names", *none)


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", F.explode(localenames.values(F.col("names"))).alias("e")).select("id", "e.*")


def _stage(build: dict, *stages: str):
    return lambda s, d: _rows(localenames.fix(_profiles(s, d, build), stages))


def _language_words(spark, d) -> DataFrame:
    """Each word of the documents as an English surname: the locales that the language stages copy it to."""
    none = [F.lit(None).cast("string").alias(c) for c in ("first", "middle", "last", "maiden", "suffix")]
    rows = _words(spark, d).select(F.col("word").alias("id"), F.create_map(F.lit("en-US"), F.create_map(F.lit("last_name"), F.col("word"))).alias("names"), *none)
    found = _rows(localenames.fix(rows, ("Lithuanian", "Estonian", "LatinLanguage", "Hebrew")))
    return found.select(F.col("id").alias("word"), "locale", "value")


BOTH = {"en-US": {"first_name": "src_first", "last_name": "src_last"}}
CYR = "regexp_matches({}, '[\\x{{0400}}-\\x{{052F}}]')"


def cyr(c: str) -> str:
    return CYR.format(c)


def queries() -> dict:
    f, rows = F.col, _stage
    return {
        "pair_fields": q_pair_fields,
        "full_scores": q_full_scores,
        "resolved_mappings": q_resolved,
        "place_locales": lambda s, d: _values(s, SAMPLE_PLACES, "place").select("place", locales.place_locale(f("place")).alias("locale")),
        "word_locales": lambda s, d: _words(s, d).select("word", locales.cyrillic_locale(f("word")).alias("cyrillic"), locales.latin_locale(f("word")).alias("latin")),
        "surname_bases": lambda s, d: _values(s, SURNAMES, "surname").select("surname", locales.surname_base(f("surname")).alias("base")),
        "romanised": lambda s, d: _values(s, NAMES, "name").select("name", locales.romanise(f("name")).alias("latin"), locales.is_basic_latin(f("name")).alias("basic"), names.is_purely(f("name"), "Cyrillic").alias("cyrillic")),
        "namefix_cyrillic_to_ru": rows(BOTH, "CyrillicToRu"),
        "namefix_translit": rows(BOTH, "CyrillicToRu", "Translit"),
        "namefix_ukrainian": rows(BOTH, "Ukrainian"),
        "namefix_script_split": rows({"en-US": {"first_name": "concat(src_first, ' ', dst_first)"}}, "ScriptSplit"),
        "namefix_ensure_english": rows({"ru": {"first_name": "src_first"}, "de": {"last_name": "concat(dst_last, 'ß')"}}, "EnsureEnglish"),
        "namefix_duplicates": rows({"en-US": {"first_name": "dst_first"}, "de": {"first_name": "src_first"}, "ru": {"first_name": "src_first"}}, "DuplicateRemoval"),
        "namefix_cleanup": rows({"en-US": {"first_name": "concat('  ', dst_first, ' ')", "last_name": "' '"}, "en": {"first_name": "src_first"}}, "Cleanup"),
        "namefix_languages": _language_words,
    }


def oracle_sql() -> dict[str, str]:
    o, union = fixture.oracle, " UNION ALL "
    row = lambda loc, field, value, where="true": f"SELECT id, '{loc}' AS locale, '{field}' AS field, {value} AS value FROM persons WHERE {where}"
    plain = union.join(f"SELECT id, CASE WHEN {cyr(c)} THEN 'ru' ELSE 'en-US' END AS locale, '{f}' AS field, {c} AS value FROM persons" for f, c in (("first_name", "src_first"), ("last_name", "src_last")))
    latin = union.join(row("en-US", f, roman_sql(c), cyr(c)) for f, c in (("first_name", "src_first"), ("last_name", "src_last")))
    ukrainian = lambda c: f"{cyr(c)} AND (regexp_matches({c}, '[іїєґІЇЄҐ]') OR regexp_matches(lower({c}), '{names.UKRAINIAN_ENDINGS}'))"
    letters = lambda table, default: "CASE " + " ".join(f"WHEN regexp_matches(word, '[{x}]') THEN '{loc}'" for loc, x in table) + f" ELSE '{default}' END"
    values = lambda rows, name: f"n({name}) AS (VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in rows) + ")"
    return {
        "pair_fields": pair_fields_sql(),
        "place_locales": f"WITH {values(SAMPLE_PLACES, 'place')} SELECT place, {place_sql('place')} AS locale FROM n",
        "word_locales": f"WITH {WORDS_SQL} SELECT word, {letters(locales.CYRILLIC_LETTERS, 'ru')} AS cyrillic, {letters(locales.LATIN_LETTERS, 'en')} AS latin FROM w",
        "surname_bases": f"WITH {values(SURNAMES, 'surname')} SELECT surname, {surname_sql('surname')} AS base FROM n",
        "romanised": f"WITH {NAMES_SQL} SELECT name, {roman_sql('name')} AS latin, NOT regexp_matches(name, '[^\\x00-\\x7F]') AS basic, {script_sql('name')} = 'Cyrillic' AS cyrillic FROM n",
        "namefix_cyrillic_to_ru": o(plain),
        "namefix_translit": o(plain + union + latin),
        "namefix_ukrainian": o(row("en-US", "first_name", "src_first") + union + row("en-US", "last_name", "src_last") + union + row("uk", "first_name", "src_first", ukrainian("src_first")) + union + row("uk", "last_name", "src_last", ukrainian("src_last"))),
        "namefix_script_split": o(row("en-US", "first_name", f"CASE WHEN {cyr('src_first')} THEN dst_first ELSE src_first || ' ' || dst_first END") + union + row("ru", "first_name", "src_first", cyr("src_first"))),
        "namefix_ensure_english": o(row("ru", "first_name", "src_first") + union + row("de", "last_name", "dst_last || 'ß'") + union + row("en-US", "first_name", roman_sql("src_first")) + union + row("en-US", "last_name", "dst_last || 'ss'")),
        "namefix_duplicates": o(row("en-US", "first_name", "dst_first") + union + row("ru", "first_name", "src_first", "src_first <> dst_first")),
        "namefix_cleanup": o(row("en-US", "first_name", "dst_first") + union + row("en", "first_name", "src_first", "lower(src_first) <> lower(dst_first)")),
        "namefix_languages": f"WITH {WORDS_SQL}, x AS (SELECT word, {latin_sql('word')} AS language FROM w WHERE NOT {cyr('word')}) SELECT word, 'en-US' AS locale, word AS value FROM w UNION ALL SELECT word, language, word FROM x WHERE language <> 'en' UNION ALL SELECT word, 'he', word FROM w WHERE regexp_matches(word, '[\\x{{0590}}-\\x{{05FF}}]')",
    }

"""Queries of field differences, payloads, people already there, deliveries, surnames by marriage and the locale model's measures; and their SQL.

Both trees' people get their other fields from the same customers: segments as places and middle names, names as nicknames and photos.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery, diff, existing, graph, locale_model, marriage
from ..scratch import Scratch
from . import fixture
from .registry import _table

YEAR = "CAST(birth_year AS VARCHAR(4))"
#: Years, about years, months and days, by the number that the person's id leaves.
DATED = "CASE MOD({m}, 6) WHEN 0 THEN {y} WHEN 1 THEN 'ABT ' || {y} WHEN 2 THEN 'MAR ' || {y} WHEN 3 THEN '12 OCT ' || {y} WHEN 4 THEN '31 feb ' || {y} END"
DEATH = "CAST(birth_year + 61 AS VARCHAR(4))"
RICH = f"""
, c AS (SELECT c_custkey AS id, c_mktsegment || ', ' || c_name AS address, c_name AS phone, c_mktsegment AS words, CAST(c_nationkey AS BIGINT) AS nation FROM {{customer}}),
rich_src AS (
  SELECT p.id, CASE WHEN MOD(p.id, 29) = 3 THEN '  ' ELSE src_first END AS first, src_last AS last,
    CASE WHEN gender = 'Female' AND MOD(p.id, 3) = 1 THEN CASE WHEN MOD(p.id, 2) = 0 THEN UPPER(dst_last) ELSE 'Orlova' || CAST(nation AS VARCHAR(9)) END END AS maiden,
    CASE WHEN MOD(p.id, 4) = 0 THEN ' ' || SUBSTR(words, 1, 6) END AS middle, CASE WHEN MOD(p.id, 9) = 2 THEN phone END AS nickname, CASE WHEN MOD(p.id, 31) = 4 THEN 'Jr.' END AS suffix,
    {DATED.format(m="p.id", y=YEAR)} AS birth_date, CASE WHEN MOD(p.id, 3) = 0 THEN {DATED.format(m="p.id + nation", y=DEATH)} END AS death_date, CASE WHEN MOD(p.id, 8) = 0 THEN {DEATH} WHEN MOD(p.id, 8) = 1 THEN 'unknown' END AS burial_date,
    CASE WHEN MOD(p.id, 2) = 0 THEN address END AS birth_place, CASE WHEN MOD(p.id, 5) = 0 THEN address || ' ' END AS death_place, CASE WHEN MOD(p.id, 7) = 0 THEN '' WHEN MOD(p.id, 7) = 1 THEN address END AS burial_place,
    gender, CASE MOD(p.id, 5) WHEN 0 THEN phone || '/1|' || phone || '/2' WHEN 1 THEN phone || '/2' END AS pictures, father_id, mother_id
  FROM persons p JOIN c ON c.id = p.id),
rich_dst AS (
  SELECT p.id, CASE WHEN MOD(p.id, 12) <> 7 THEN dst_first END AS first, dst_last AS last, CASE WHEN MOD(p.id, 14) = 3 THEN dst_last || 'a' END AS maiden, CASE WHEN MOD(p.id, 8) = 0 THEN 'x' ELSE ' ' END AS middle,
    CASE WHEN MOD(p.id, 18) = 2 THEN phone END AS nickname, CAST(NULL AS VARCHAR(3)) AS suffix,
    {DATED.format(m="p.id + p.r", y=YEAR)} AS birth_date, CASE WHEN MOD(p.id, 2) = 0 THEN {DEATH} END AS death_date, CASE WHEN MOD(p.id, 16) = 0 THEN 'MAY ' || {DEATH} END AS burial_date,
    CASE WHEN MOD(p.id, 3) = 0 THEN address END AS birth_place, CASE WHEN MOD(p.id, 10) = 0 THEN address END AS death_place, CASE WHEN MOD(p.id, 4) = 0 THEN address END AS burial_place,
    CASE WHEN MOD(p.id, 8) = 1 THEN 'Unknown' ELSE gender END AS gender, CASE WHEN MOD(p.id, 3) = 0 THEN phone || '/1' END AS pictures, father_id, mother_id
  FROM persons p JOIN c ON c.id = p.id WHERE MOD(p.id, 11) <> 10)"""


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source and target. The people that both are made of are written once, so that their plan isn't repeated for each side."""
    persons = Scratch(spark, "people").keep(fixture.persons(spark, sf_dir), "persons")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    tables = "WITH" + RICH.lstrip().removeprefix(",").replace("FROM persons p", "FROM {persons} p")
    return tuple(spark.sql(f"{tables} SELECT * FROM rich_{side}", persons=persons, customer=customer).withColumn("photos", F.split("pictures", r"\|")) for side in ("src", "dst"))


def _rich(body: str) -> str:
    return f"WITH RECURSIVE {fixture.PERSONS.format(customer='customer')}{RICH.format(customer='customer')} {body}"


def _mapping(spark, d) -> DataFrame:
    """Everyone whom both trees have."""
    return _table(spark, d, "customer").where("MOD(c_custkey, 11) <> 10").select(F.col("c_custkey").alias("src_id"), F.col("c_custkey").alias("dst_id"))


def q_differences(spark, d) -> DataFrame:
    return diff.differences(*_trees(spark, d), _mapping(spark, d))


def _blank(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


def _precision(c: str) -> str:
    """0 for years, 1 for months, 2 for days that exist; null for texts without a year."""
    body = f"regexp_replace({c}, '^ABT ', '')"
    return f"CASE WHEN NOT regexp_matches({body}, '[0-9]{{4}}') OR {c} IS NULL THEN NULL WHEN regexp_matches({body}, '^[0-9]+ ') AND try_strptime({body}, '%d %b %Y') IS NOT NULL THEN 2 WHEN regexp_matches({body}, '[A-Za-z]{{3}}') THEN 1 ELSE 0 END"


def _differences_sql() -> str:
    parts = []
    for field, c in (("FirstName", "first"), ("LastName", "last"), ("MiddleName", "middle"), ("Nickname", "nickname"), ("Suffix", "suffix"), ("BirthPlace", "birth_place"), ("DeathPlace", "death_place"), ("BurialPlace", "burial_place")):
        parts.append(f"SELECT s.id, '{field}' AS field, trim(s.{c}) AS src_value, NULL::VARCHAR AS dst_value, 'Add' AS action FROM both_ WHERE NOT {_blank(f's.{c}')} AND {_blank(f'd.{c}')}")
    parts.append(f"SELECT s.id, 'MaidenName', trim(s.maiden), NULL, 'Add' FROM both_ WHERE NOT {_blank('s.maiden')} AND {_blank('d.maiden')} AND lower(s.maiden) IS DISTINCT FROM lower(d.last)")
    parts.append("SELECT s.id, 'Gender', s.gender, NULL, 'Add' FROM both_ WHERE s.gender <> 'Unknown' AND d.gender = 'Unknown'")
    for field, c in (("BirthDate", "birth_date"), ("DeathDate", "death_date"), ("BurialDate", "burial_date")):
        a, b = _precision(f"s.{c}"), _precision(f"d.{c}")
        parts.append(f"SELECT s.id, '{field}', s.{c}, CASE WHEN {b} IS NOT NULL THEN d.{c} END, CASE WHEN {b} IS NULL THEN 'Add' ELSE 'Update' END FROM both_ WHERE {a} > coalesce({b}, -1)")
    fresh = "list_filter(string_split(s.pictures, '|'), lambda x: NOT list_contains(coalesce(string_split(d.pictures, '|'), []), x))[1]"
    parts.append(f"SELECT s.id, 'PhotoUrl', {fresh}, string_split(d.pictures, '|')[1], 'AddPhoto' FROM both_ WHERE {fresh} IS NOT NULL")
    union = " UNION ALL ".join(parts).replace("FROM both_", "FROM rich_src s JOIN rich_dst d ON d.id = s.id")
    return f", f AS ({union})"


SERVICE_DATE = """CASE WHEN {c} IS NULL OR NOT regexp_matches({c}, '[0-9]{{4}}') THEN NULL ELSE '"date":{{' || concat_ws(',', '"day":' || nullif(regexp_extract({c}, '(^| )([0-9]{{1,2}}) ', 2), ''),
  '"month":' || CASE upper(regexp_extract({c}, '([A-Za-z]{{3}}) [0-9]{{4}}$', 1)) WHEN 'MAR' THEN '3' WHEN 'OCT' THEN '10' WHEN 'FEB' THEN '2' WHEN 'MAY' THEN '5' END, '"year":' || regexp_extract({c}, '[0-9]{{4}}')) || '}}' END"""


def _event_sql(key: str, date: str, place: str) -> str:
    quoted = f"""'"location":{{"place_name":' || to_json({place}) || '}}'"""
    return f"""CASE WHEN {date} IS NOT NULL OR {place} IS NOT NULL THEN '"{key}":{{' || concat_ws(',', {SERVICE_DATE.format(c=date)}, {quoted}) || '}}' END"""


def _payload_sql() -> str:
    fields = [("FirstName", "first_name"), ("MiddleName", "middle_name"), ("LastName", "last_name"), ("MaidenName", "maiden_name"), ("Suffix", "suffix"), ("Nickname", "nicknames")]
    wide = ", ".join(f"max(src_value) FILTER (field = '{f}') AS {f}" for f in [f for f, _ in fields] + ["Gender"] + [e + p for e in ("Birth", "Death", "Burial") for p in ("Date", "Place")])
    items = ", ".join(f"""'"{k}":' || to_json({f})""" for f, k in fields)
    events = ", ".join(_event_sql(e.lower(), f"{e}Date", f"{e}Place") for e in ("Birth", "Death", "Burial"))
    return f"""{_differences_sql()}, wide AS (SELECT id, count(*) AS n_fields, {wide} FROM f WHERE action <> 'AddPhoto' GROUP BY id),
    sent AS (SELECT id AS src_id, id AS dst_id, n_fields, '{{' || concat_ws(',', {items}, '"gender":"' || lower(Gender) || '"', {events}) || '}}' AS payload FROM wide)"""


def _creation_sql() -> str:
    text = lambda k, c: f"""'"{k}":' || to_json({c})"""
    items = ", ".join(text(k, c) for k, c in (("first_name", "first"), ("middle_name", "middle"), ("last_name", "last"), ("maiden_name", "maiden"), ("suffix", "suffix"), ("nicknames", "nickname")))
    given = lambda c: f"CASE WHEN NOT {_blank(c)} THEN {c} END"
    # a date without a year isn't read, and leaves an empty event
    events = ", ".join(_event_sql(e, f"({given(e + '_date')})", f"({given(e + '_place')})") for e in ("birth", "death", "burial"))
    return f"""SELECT id, '{{' || concat_ws(',', {items}, CASE WHEN gender <> 'Unknown' THEN '"gender":"' || lower(gender) || '"' END, {events}, '"is_alive":' || CASE WHEN coalesce(death_date, '') = '' THEN 'true' ELSE 'false' END) || '}}' AS payload
    FROM rich_src WHERE MOD(id, 11) = 10 AND (NOT {_blank("first")} OR NOT {_blank("last")})"""


def q_existing(spark, d) -> DataFrame:
    """Everyone of the source as if to be added to its first relative."""
    src, dst = _trees(spark, d)
    kin = lambda df: graph.relatives(df.select("id", "father_id", "mother_id")).where("relation <> 'sibling'")
    first = kin(src).groupBy(F.col("id").alias("src_id")).agg(F.min("other").alias("dst_id"))
    added = src.select(F.col("id").alias("src_id"), "first", "last").join(first, "src_id").join(dst.select(F.col("id").alias("dst_id")), "dst_id")
    families = kin(dst).select(F.col("id").alias("dst_id"), F.col("other").alias("at"), F.col("other").alias("member")).distinct()
    return existing.existing_relatives(added, families, dst)


def _kin_sql(name: str, table: str) -> str:
    """Parents, children and spouses of a table; parents need not be in it."""
    up = f"SELECT id AS child, father_id AS parent FROM {table} WHERE father_id IS NOT NULL UNION SELECT id, mother_id FROM {table} WHERE mother_id IS NOT NULL"
    return f"""{name}_up AS ({up}), {name} AS (SELECT child AS id, parent AS other FROM {name}_up UNION SELECT parent, child FROM {name}_up
    UNION SELECT father_id, mother_id FROM {table} WHERE father_id IS NOT NULL AND mother_id IS NOT NULL UNION SELECT mother_id, father_id FROM {table} WHERE father_id IS NOT NULL AND mother_id IS NOT NULL)"""


def _existing_sql() -> str:
    n = lambda c: f"lower(replace(trim({c}), '  ', ' '))"
    either = lambda a, b: f"(coalesce({n(a)}, '') = '' OR coalesce({n(b)}, '') = '' OR {n(a)} = {n(b)})"
    return _rich(f""", {_kin_sql("ks", "rich_src")}, {_kin_sql("kd", "rich_dst")},
    added AS (SELECT s.id AS src_id, s.first, s.last, min(ks.other) AS dst_id FROM rich_src s JOIN ks ON ks.id = s.id GROUP BY ALL),
    hits AS (SELECT a.src_id, m.id AS dst_id, concat_ws(' ', nullif(trim(m.first), ''), nullif(trim(m.last), '')) AS name, a.dst_id AS via, row_number() OVER (PARTITION BY a.src_id ORDER BY m.id) AS k
      FROM added a JOIN rich_dst r ON r.id = a.dst_id JOIN kd ON kd.id = a.dst_id JOIN rich_dst m ON m.id = kd.other
      WHERE {either("a.first", "m.first")} AND ({either("a.last", "m.last")} OR coalesce({n("a.last")} = {n("m.maiden")}, false)))
    SELECT src_id, dst_id, name, via FROM hits WHERE k = 1""")


def _receive(attempt: int, row: dict) -> None:
    """A receiver that forbids some people and fails for others at the first attempt."""
    number = int(row["src_id"])
    if number % 7 == 3:
        raise delivery.Forbidden("no permission")
    if number % 5 == 2 and attempt == 1:
        raise OSError("try again")


def q_delivery(spark, d) -> DataFrame:
    """Outcomes after two runs over the payloads of all differences."""
    scratch = Scratch(spark, "delivery")
    nodes = scratch.keep(diff.service_payloads(q_differences(spark, d)), "nodes")
    sink = delivery.Delivery(spark, f"{scratch.root}/000-store")
    for attempt in (1, 2):
        sink.run(nodes, partial(_receive, attempt), batches=2)
    return sink.state().select(F.col("src_id").cast("long").alias("src_id"), "outcome", "reason", "attempts")


WIVES = """
, w AS (SELECT id, gender, blk, r, fl, fc, ll, lc FROM named),
wives AS (
  SELECT w.id, w.gender, CASE WHEN MOD(w.id, 5) = 0 THEN w.ll ELSE 'Orlova' END AS last,
    CASE MOD(w.id, 4) WHEN 0 THEN h.ll || 'a' WHEN 1 THEN CASE WHEN h.ll LIKE '%iy' THEN SUBSTR(h.ll, 1, LENGTH(h.ll) - 2) || 'aya' ELSE UPPER(h.ll) END WHEN 2 THEN ' ' END AS maiden,
    CASE WHEN MOD(w.id, 3) = 0 THEN w.lc ELSE 'Орлова' END AS ru_last, CASE MOD(w.id, 4) WHEN 0 THEN h.lc || 'а' WHEN 1 THEN CASE WHEN h.lc LIKE '%ий' THEN SUBSTR(h.lc, 1, LENGTH(h.lc) - 2) || 'ая' ELSE h.lc END END AS ru_maiden,
    h.ll AS spouse_last, CASE WHEN MOD(w.id, 2) = 0 THEN h.lc END AS spouse_ru
  FROM w LEFT JOIN w h ON h.blk = w.blk AND ((w.r = 1 AND h.r = 0) OR (w.r = 5 AND h.r = 2)))"""


def q_married(spark, d) -> DataFrame:
    rows = spark.sql(f"WITH {fixture.PERSONS}{WIVES} SELECT * FROM wives", customer=_table(spark, d, "customer").select("c_custkey"))
    entry = lambda last, maiden: F.map_filter(F.create_map(F.lit("last_name"), F.col(last), F.lit("maiden_name"), F.col(maiden)), lambda _, v: v.isNotNull())
    some = F.map_filter(F.create_map(F.lit("ru"), F.col("spouse_ru")), lambda _, v: v.isNotNull())
    df = rows.withColumns({"names": F.create_map(F.lit("ru"), entry("ru_last", "ru_maiden")), "spouse_names": some})
    ru = lambda f: F.try_element_at(F.try_element_at("names", F.lit("ru")), F.lit(f))
    return marriage.married_surnames(df).select("id", "last", "maiden", ru("last_name").alias("ru_last"), ru("maiden_name").alias("ru_maiden"))


def _is_of_sql(a: str, b: str) -> str:
    a, b = f"lower(trim({a}))", f"lower(trim({b}))"
    cyrillic = lambda x: f"regexp_matches({x}, '[\\x{{0400}}-\\x{{052F}}]')"
    woman = f"""CASE WHEN {cyrillic(b)} THEN CASE WHEN regexp_matches({b}, '..ий$') THEN regexp_replace({b}, 'ий$', 'ая') WHEN regexp_matches({b}, '(ов|ев|ёв|ин|ын)$') THEN {b} || 'а' END
      WHEN regexp_matches({b}, '..iy$') THEN regexp_replace({b}, 'iy$', 'aya') WHEN regexp_matches({b}, 'sky$') THEN regexp_replace({b}, 'y$', 'aya') WHEN regexp_matches({b}, '(ov|ev|in|yn)$') THEN {b} || 'a' END"""
    man = f"""CASE WHEN {cyrillic(a)} THEN CASE WHEN regexp_matches({a}, '..ая$') THEN regexp_replace({a}, 'ая$', 'ий') WHEN regexp_matches({a}, '(ова|ева|ёва|ина|ына)$') THEN regexp_replace({a}, 'а$', '') END
      WHEN regexp_matches({a}, '..aya$') THEN regexp_replace({a}, 'aya$', 'iy') WHEN regexp_matches({a}, '(ova|eva|ina|yna)$') THEN regexp_replace({a}, 'a$', '') END"""
    return f"coalesce({a} <> '' AND {b} <> '' AND (coalesce({a} = {b}, false) OR coalesce(({woman}) = {a}, false) OR coalesce(({man}) = {b}, false)), false)"


def _married_sql() -> str:
    swap = lambda last, maiden, spouse: f"(gender = 'Female' AND spouse_last IS NOT NULL AND {_is_of_sql(maiden, spouse)} AND NOT {_is_of_sql(last, spouse)})"
    copy = lambda last, maiden: f"((gender = 'Male' OR (gender = 'Female' AND spouse_last IS NULL)) AND coalesce(trim({maiden}), '') = '')"
    both = lambda last, maiden, spouse: f"CASE WHEN {swap(last, maiden, spouse)} THEN {maiden} ELSE {last} END AS {last}, CASE WHEN {copy(last, maiden)} OR {swap(last, maiden, spouse)} THEN {last} ELSE {maiden} END AS {maiden}"
    return f"WITH {fixture.PERSONS.format(customer='customer')}{WIVES} SELECT id, {both('last', 'maiden', 'spouse_last')}, {both('ru_last', 'ru_maiden', 'coalesce(spouse_ru, spouse_last)')} FROM wives"


def q_locale_folds(spark, d) -> DataFrame:
    """Every fold's measures of a model of the language of words, over all words of documents with a language."""
    words = _table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("locale"), F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("name")).distinct()
    return locale_model.cross_validate(words.select("name", F.lit("word").alias("name_type"), F.lit("unknown").alias("gender"), "locale"))


def queries() -> dict:
    return {
        "field_differences": q_differences,
        "identical_people": lambda s, d: diff.identical(_mapping(s, d), q_differences(s, d)),
        "service_payloads": lambda s, d: diff.service_payloads(q_differences(s, d)),
        "creation_payloads": lambda s, d: diff.creation_payloads(diff.usable(_trees(s, d)[0].join(_mapping(s, d), F.col("id") == F.col("src_id"), "left_anti"))),
        "existing_relatives": q_existing,
        "delivery_outcomes": q_delivery,
        "married_surnames": q_married,
        "locale_folds": q_locale_folds,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "field_differences": _rich(f"{_differences_sql()} SELECT id AS src_id, id AS dst_id, field, src_value, dst_value, action FROM f"),
        "identical_people": _rich(f"{_differences_sql()} SELECT id AS src_id, id AS dst_id FROM rich_dst WHERE id NOT IN (SELECT id FROM f)"),
        "service_payloads": _rich(f"{_payload_sql()} SELECT * FROM sent"),
        "creation_payloads": _rich(_creation_sql()),
        "existing_relatives": _existing_sql(),
        "delivery_outcomes": _rich(f"""{_payload_sql()} SELECT src_id, CASE WHEN MOD(src_id, 7) = 3 THEN 'skipped' ELSE 'done' END AS outcome, CASE WHEN MOD(src_id, 7) = 3 THEN 'no permission' END AS reason,
          CASE WHEN MOD(src_id, 7) <> 3 AND MOD(src_id, 5) = 2 THEN 2 ELSE 1 END::BIGINT AS attempts FROM sent"""),
        "married_surnames": _married_sql(),
    }

"""Persons and families of two trees as views over the driver's customer table; one text for Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PERSONS = """
k AS (SELECT c_custkey AS id, CAST(FLOOR(c_custkey / 7.0) AS BIGINT) AS blk, CAST(MOD(c_custkey, 7) AS INT) AS r FROM {customer}),
p AS (
  SELECT id, blk, r,
    CASE WHEN r IN (0,2,6) THEN 'Male' WHEN r IN (1,3,5) THEN 'Female' ELSE 'Unknown' END AS gender,
    CAST(1800 + MOD(blk * 13, 100) + CASE WHEN r IN (0,1) THEN 0 WHEN r = 6 THEN 50 ELSE 25 END + MOD(id, 3) AS INT) AS birth_year,
    CASE WHEN r IN (2,3,4) THEN blk * 7 WHEN r = 6 THEN blk * 7 + 2 WHEN r = 1 AND blk > 0 THEN CAST(FLOOR((blk - 1) / 4.0) AS BIGINT) * 7 END AS father_id,
    CASE WHEN r IN (2,3,4) THEN blk * 7 + 1 WHEN r = 6 THEN blk * 7 + 5 WHEN r = 1 AND blk > 0 THEN CAST(FLOOR((blk - 1) / 4.0) AS BIGINT) * 7 + 1 END AS mother_id
  FROM k
), fn(g, i, cyr, lat) AS (VALUES ('Male',0,'Иван','Ivan'),('Male',1,'Пётр','Peter'),('Male',2,'Николай','Nikolay'),('Male',3,'Сергей','Sergei'),('Male',4,'Александр','Alexander'),('Male',5,'Михаил','Mikhail'),('Male',6,'Григорий','Grigory'),('Male',7,'Тимофей','Timofey'),
  ('Female',0,'Мария','Maria'),('Female',1,'Анна','Anna'),('Female',2,'Ольга','Olga'),('Female',3,'Елена','Helen'),('Female',4,'Ирина','Irina'),('Female',5,'Софья','Sofia'),('Female',6,'Марина','Marina'),('Female',7,'Зинаида','Zinaida')),
s1(i, cyr, lat) AS (VALUES (0,'Ива','Iva'),(1,'Пет','Pet'),(2,'Сидо','Sido'),(3,'Моро','Moro'),(4,'Бело','Belo'),(5,'Куз','Kuz'),(6,'Лаз','Laz'),(7,'Гро','Gro'),(8,'Тара','Tara'),(9,'Шере','Shere')),
s2(i, cyr, lat) AS (VALUES (0,'н','n'),(1,'ра','ra'),(2,'ми','mi'),(3,'де','de'),(4,'бо','bo'),(5,'ле','le'),(6,'ту','tu'),(7,'го','go'),(8,'са','sa'),(9,'ви','vi')),
s3(i, cyr, lat) AS (VALUES (0,'ов','ov'),(1,'ров','rov'),(2,'нин','nin'),(3,'ский','skiy'),(4,'енко','enko'),(5,'лев','lev'),(6,'дин','din'),(7,'ков','kov'),(8,'цкий','tskiy'),(9,'шин','shin')),
named AS (
  SELECT p.id, p.blk, p.r, p.gender, p.birth_year, p.father_id, p.mother_id, fn.cyr AS fc, fn.lat AS fl, s1.cyr || s2.cyr || s3.cyr AS lc, s1.lat || s2.lat || s3.lat AS ll
  FROM p JOIN fn ON fn.i = MOD(CAST(FLOOR(p.blk / (p.r + 1.0)) AS BIGINT) * 5 + p.blk + p.r * 3, 8) AND fn.g = CASE WHEN p.r IN (0,2,4,6) THEN 'Male' ELSE 'Female' END
  JOIN s1 ON s1.i = MOD(p.blk * 7, 10) JOIN s2 ON s2.i = MOD(CAST(FLOOR(p.blk / 3.0) AS BIGINT), 10) JOIN s3 ON s3.i = MOD(CAST(FLOOR(p.blk / 11.0) AS BIGINT) + p.blk, 10)
),
persons AS (
  SELECT id, blk, r, gender, birth_year, father_id, mother_id,
    CASE WHEN MOD(id, 3) = 0 THEN fc ELSE fl END AS src_first,
    CASE WHEN MOD(id, 3) = 0 THEN lc WHEN MOD(id, 17) = 5 THEN SUBSTR(ll, 1, 4) || SUBSTR(ll, 6) ELSE ll END AS src_last,
    CASE WHEN MOD(id, 19) = 7 THEN SUBSTR(fl, 1, 2) || SUBSTR(fl, 4) ELSE fl END AS dst_first, CASE WHEN MOD(id, 23) = 9 THEN SUBSTR(ll, 1, 3) || 'e' || SUBSTR(ll, 4) ELSE ll END AS dst_last
  FROM named
)"""
#: Every thirteenth person of the source has no year of birth.
SRC_YEAR = "CASE WHEN MOD(id, 13) <> 5 THEN birth_year END"


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both trees' spelling of every person."""
    return spark.sql(f"WITH {PERSONS} SELECT * FROM persons", customer=customers(spark, sf_dir))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' keys, dealt over all cores: a column of numbers is so small that Spark reads millions of its rows in one task, with all that is made of them."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return rows.repartition(max(rows.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism), "c_custkey")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persons(spark, sf_dir).selectExpr("id", "src_first AS first", "src_last AS last", "gender", f"{SRC_YEAR} AS birth_year", "father_id", "mother_id")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some people are missing here, others born a year later."""
    return persons(spark, sf_dir).where("MOD(id, 11) <> 10").selectExpr("id", "dst_first AS first", "dst_last AS last", "gender", "birth_year + CASE WHEN MOD(id, 5) = 0 THEN 1 ELSE 0 END AS birth_year", "father_id", "mother_id")


def oracle(body: str) -> str:
    """A query over persons, src and dst for the oracle."""
    trees = f""", src AS (SELECT id, src_first AS first, src_last AS last, gender, {SRC_YEAR} AS birth_year, father_id, mother_id FROM persons),
dst AS (SELECT id, dst_first AS first, dst_last AS last, gender, birth_year + CASE WHEN MOD(id, 5) = 0 THEN 1 ELSE 0 END AS birth_year, father_id, mother_id FROM persons WHERE MOD(id, 11) <> 10)
"""
    return f"WITH RECURSIVE {PERSONS.format(customer='customer')}{trees} {body}"

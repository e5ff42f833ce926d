"""Service-style JSON: profiles with localised names and dated events, unions of partners and children, stored decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "struct<date:struct<day:int,month:int,year:int,formatted_date:string>,location:struct<city:string,state:string,country:string,place_name:string>>"
PROFILE = f"id string, first_name string, middle_name string, last_name string, maiden_name string, suffix string, gender string, is_alive boolean, names map<string,map<string,string>>, birth {EVENT}, death {EVENT}"
UNION = "id string, status string, partners array<string>, children array<string>"


def _results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of {"results": [...]}; a bare object is one row."""
    rows = spark.read.schema(f"results array<struct<{_inner(schema)}>>, {schema}").option("multiLine", True).json(path)
    names = [x.name for x in rows.schema.fields[1:]]
    return rows.select(F.explode(F.coalesce("results", F.array(F.struct(*names)))).alias("r")).select("r.*")


def _inner(schema: str) -> str:
    depth, out, start = 0, [], 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return ",".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in out)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return _results(spark, path, PROFILE)


def read_unions(spark: SparkSession, path: str) -> DataFrame:
    return _results(spark, path, UNION)


def localised(profiles: DataFrame) -> DataFrame:
    """id, locale, field and value of every localised name."""
    rows = profiles.select("id", F.explode("names").alias("locale", "fields"))
    return rows.select("id", "locale", F.explode("fields").alias("field", "value")).where(F.trim("value") != "")


def parent_links(unions: DataFrame) -> DataFrame:
    """child and parent; ids keep their last path part."""
    last = lambda c: F.regexp_replace(c, "^.*/", "")
    return unions.select(F.explode("children").alias("c"), "partners").select(last(F.col("c")).alias("child"), F.explode("partners").alias("p")).select("child", last(F.col("p")).alias("parent")).distinct()

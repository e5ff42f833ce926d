"""Equivalent given names: each group is a star of one base name and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base name and its variants.
GROUPS = """
иван: ivan john johann jan jean giovanni juan ioan
александр: alexander alex oleksandr aleksander саша sasha
михаил: michael michel miguel mykhailo michal миша
николай: nicholas nicolas mykola mikolaj коля
пётр: peter pierre pedro petro piotr
павел: paul pavel pawel pablo паша
андрей: andrew andrei andriy andrzej andre
сергей: sergei serge sergiy серёжа
дмитрий: dmitry dmitri dmytro дима
владимир: vladimir volodymyr wladimir володя
борис: boris borys
григорий: gregory grigory hryhoriy гриша
василий: vasily basil vasyl вася
яков: jacob james jakub yakov
семён: simon semen семен
фёдор: theodore fedor федор федя
мария: maria mary marie марія маша
анна: anna anne ann hanna ганна аня
елена: helen helena elena olena лена
екатерина: catherine katarina kateryna катя
наталья: natalia natalie nataliya наташа
ольга: olga olha helga
татьяна: tatiana tanya tetiana таня
ирина: irina irene iryna
светлана: svetlana svitlana света
людмила: ludmila lyudmila liudmyla люда
евгения: eugenia yevheniya женя
софья: sophia sofia zofia софія соня
елизавета: elizabeth yelyzaveta elzbieta лиза
валентина: valentina валя
галина: galina halyna галя
"""


def edges() -> list[tuple[str, str]]:
    """Base and variant, in both directions."""
    pairs = [(line.split(":")[0], v) for line in GROUPS.strip().splitlines() for v in line.split(":")[1].split()]
    return sorted({(a, b) for a, b in pairs} | {(b, a) for a, b in pairs})


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edges(), "a string, b string")


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a file of two columns: a name and its variants, separated by blanks; quotes are dropped."""
    rows = spark.read.text(path).select(F.split("value", ",", 2).alias("c")).where(F.size("c") == 2)
    bare = lambda c: F.lower(F.trim(F.replace(c, F.lit('"'), F.lit(""))))
    pairs = rows.select(bare(F.col("c")[0]).alias("a"), F.explode(F.split(bare(F.col("c")[1]), " +")).alias("b")).where("a <> '' and b <> ''")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()

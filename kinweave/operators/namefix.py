"""Name repair: an ordered list of column stages over profiles, and the changes they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

#: Titles before a name and suffixes after it.
TITLES = r"(?:Dr|Prof|Rev|Fr|Gen|Col|Maj|Capt|Lt|Sgt|Sir|Dame|Lord|Lady|Duke|Duchess|Earl|Count|Countess|Baron|Baroness|Prince|Princess|Hon|Judge|князь|княгиня|граф|графиня|барон|баронесса|отец|генерал|полковник|майор|капитан|профессор|доктор|академик)"
SUFFIXES = r"(?:Jr|Sr|II|III|IV|V|PhD|Esq|MD)"
FIELDS = ("first", "middle", "last", "maiden", "nickname", "suffix", "title")
#: Words that stay small before a surname, and endings of patronymics.
PARTICLES = "von|van|de|der|den|zu|zur|la|le|du|di|da|del|della|ter|ten"
PATRONYMIC = "(ович|евич|ич|овна|евна|ична|инична|івна|ївна)"


def profiles(persons: DataFrame) -> DataFrame:
    """id, gender, FIELDS of persons (id, first, last, gender)."""
    none = F.lit(None).cast("string")
    return persons.select("id", "gender", "first", none.alias("middle"), "last", none.alias("maiden"), none.alias("nickname"), none.alias("suffix"), none.alias("title"))


def special(df: DataFrame) -> DataFrame:
    return df.withColumns({c: names.clean_special(F.col(c)) for c in ("first", "middle", "last", "maiden")})


def titles(df: DataFrame) -> DataFrame:
    pattern = rf"(?iu)^({TITLES}\.?)\s+(?=\S)"
    found = F.nullif(F.regexp_extract("first", pattern, 1), F.lit(""))
    return df.withColumns({"title": F.coalesce("title", found), "first": F.regexp_replace("first", pattern, "")})


def suffixes(df: DataFrame) -> DataFrame:
    pattern = rf"(?iu)[,\s]+({SUFFIXES})\.?$"
    found = F.nullif(F.regexp_extract("last", pattern, 1), F.lit(""))
    return df.withColumns({"suffix": F.coalesce("suffix", found), "last": F.regexp_replace("last", pattern, "")})


def maiden(df: DataFrame) -> DataFrame:
    pattern = r"(?iu)\s*\((?:урожд\.?\s*|née\s+|nee\s+|born\s+)?([^()]+)\)\s*$"
    found = F.nullif(F.trim(F.regexp_extract("last", pattern, 1)), F.lit(""))
    return df.withColumns({"maiden": F.coalesce("maiden", found), "last": F.regexp_replace("last", pattern, "")})


def nicknames(df: DataFrame) -> DataFrame:
    """What stands in quotes or brackets beside the given name."""
    pattern = r"\s*[\"“”«»„(]([^\"“”«»„()]+)[\"“”«»)]"
    found = F.nullif(F.trim(F.regexp_extract("first", pattern, 1)), F.lit(""))
    return df.withColumns({"nickname": F.coalesce("nickname", found), "first": F.trim(F.regexp_replace("first", pattern, ""))})


def patronymics(df: DataFrame) -> DataFrame:
    """The second of two Cyrillic given names, if it ends like a patronymic, becomes the middle name; so does one in place of the surname."""
    second = rf"^(\p{{L}}+)\s+(\p{{L}}+{PATRONYMIC})$"
    split = F.col("middle").isNull() & F.coalesce(F.col("first").rlike(second), F.lit(False))
    return df.withColumns({"middle": F.when(split, F.regexp_extract("first", second, 2)).otherwise(F.col("middle")), "first": F.when(split, F.regexp_extract("first", second, 1)).otherwise(F.col("first"))})


def particles(df: DataFrame) -> DataFrame:
    """A leading particle in small letters, the rest of a one-case surname with capitals."""
    pattern = rf"(?iu)^({PARTICLES})\s+(\S.*)$"
    rest = F.regexp_extract("last", pattern, 2)
    fixed = F.concat_ws(" ", F.lower(F.regexp_extract("last", pattern, 1)), names.capitalize(rest))
    return df.withColumn("last", F.when(F.col("last").rlike(pattern), fixed).otherwise(F.col("last")))


def birth_names(df: DataFrame) -> DataFrame:
    """A man's surname is his name at birth, if none is given."""
    return df.withColumn("maiden", F.when(F.col("gender") == "Male", F.coalesce("maiden", "last")).otherwise(F.col("maiden")))


def feminine(df: DataFrame) -> DataFrame:
    female = F.col("gender") == "Female"
    return df.withColumns({c: F.when(female, names.feminine(F.col(c))).otherwise(F.col(c)) for c in ("last", "maiden")})


def capitals(df: DataFrame) -> DataFrame:
    return df.withColumns({c: names.capitalize(F.col(c)) for c in ("first", "middle", "last", "maiden")})


def cleanup(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in FIELDS})


STAGES = {"special": special, "titles": titles, "suffixes": suffixes, "maiden": maiden, "nicknames": nicknames, "birth_names": birth_names, "patronymics": patronymics, "feminine": feminine, "capitals": capitals, "particles": particles, "cleanup": cleanup}


def fix(df: DataFrame, stages: tuple[str, ...] = tuple(STAGES)) -> DataFrame:
    for name in STAGES:
        if name in stages:
            df = STAGES[name](df)
    return df


def changes(df: DataFrame) -> DataFrame:
    """id, field, old_value and new_value of what the stages change; all in one projection."""
    kept = fix(df.withColumns({f"old_{c}": F.col(c) for c in FIELDS}))
    rows = F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"old_{c}").alias("old_value"), F.col(c).alias("new_value"))) for c in FIELDS])
    return kept.select("id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e")).select("id", "e.*")


def locale_histogram(persons: DataFrame) -> DataFrame:
    return persons.groupBy(F.when(F.col("first").rlike(names.SCRIPTS["Cyrillic"]), "ru").otherwise("en").alias("locale")).agg(F.count("*").alias("n"))

"""Surnames by marriage: whose name at birth is its surname, and whose two surnames are exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .diff import solid

#: Endings of men's surnames and of women's, tried in this order; the number is the least length.
CYRILLIC = (("ский", "ская", 4), ("цкий", "цкая", 4), ("ий", "ая", 4), ("ов", "ова", 2), ("ев", "ева", 2), ("ёв", "ёва", 2), ("ин", "ина", 2), ("ын", "ына", 2))
LATIN = (("skiy", "skaya", 4), ("sky", "skaya", 3), ("iy", "aya", 4), ("ov", "ova", 2), ("ev", "eva", 2), ("in", "ina", 2), ("yn", "yna", 2))
#: "sky" has no way back: "skaya" is read as "skiy".
LATIN_BACK = tuple(row for row in LATIN if row[0] != "sky")


def _exchanged(text: Column, endings, back: bool) -> Column:
    out = F.lit(None).cast("string")
    for man, woman, least in reversed(endings):
        old, new = (woman, man) if back else (man, woman)
        least += (len(woman) - len(man)) if back else 0
        out = F.when(F.endswith(text, F.lit(old)) & (F.length(text) >= least), F.concat(F.substr(text, F.lit(1), F.length(text) - len(old)), F.lit(new))).otherwise(out)
    return out


def other_form(surname: Column, back: bool = False) -> Column:
    """The feminine form of a masculine surname in small letters, or (back) the other way; null where no ending fits."""
    return F.when(names.contains(surname, "Cyrillic"), _exchanged(surname, CYRILLIC, back)).otherwise(_exchanged(surname, LATIN_BACK if back else LATIN, back))


def is_of(surname: Column, spouse: Column) -> Column:
    """A woman's surname is her husband's: equal, or one is the other's form, in any case. False where one is blank."""
    a, b = F.lower(solid(surname)), F.lower(solid(spouse))
    return F.coalesce(a == b, F.lit(False)) | F.coalesce(other_form(b) == a, F.lit(False)) | F.coalesce(other_form(a, True) == b, F.lit(False))


def exchanged(last: Column, maiden: Column, spouse: Column) -> Column:
    return is_of(maiden, spouse) & ~is_of(last, spouse) & solid(last).isNotNull()


def spouse_surnames(people: DataFrame, couples: DataFrame) -> DataFrame:
    """id, spouse_last and spouse_names (locale to surname, without blanks) of each person's first spouse by id. couples: id, other."""
    first = couples.groupBy("id").agg(F.min("other").alias("other"))
    by_locale = F.map_filter(F.transform_values("names", lambda _, m: F.try_element_at(m, F.lit("last_name"))), lambda _, v: solid(v).isNotNull())
    return first.join(people.select(F.col("id").alias("other"), F.col("last").alias("spouse_last"), by_locale.alias("spouse_names")), "other").drop("other")


def married_surnames(df: DataFrame) -> DataFrame:
    """Profiles (gender, last, maiden, names, spouse_last, spouse_names) with surnames and birth names set right, in every locale.

    Men's and unmarried women's blank birth names become their surnames. A married woman's two surnames are exchanged where the birth name is her husband's and the surname isn't;
    a locale in which he has no surname uses his own one. Other genders stay. names maps a locale to a map of fields (last_name, maiden_name).
    """
    get = lambda m, f: F.try_element_at(m, F.lit(f))
    married = F.coalesce(solid(F.col("spouse_last")).isNotNull() | (F.coalesce(F.cardinality("spouse_names"), F.lit(0)) > 0), F.lit(False))
    single = F.coalesce((F.col("gender") == "Male") | ((F.col("gender") == "Female") & ~married), F.lit(False))
    wife = F.coalesce((F.col("gender") == "Female") & married, F.lit(False))
    copy = lambda last, maiden: single & solid(last).isNotNull() & solid(maiden).isNull()
    swap = lambda last, maiden, spouse: wife & exchanged(last, maiden, spouse)

    def put(inner: Column, last: Column, maiden: Column) -> Column:
        rest = F.map_filter(inner, lambda k, _: ~k.isin("last_name", "maiden_name"))
        own = F.map_filter(F.map_from_arrays(F.array(F.lit("last_name"), F.lit("maiden_name")), F.array(last, maiden)), lambda _, v: v.isNotNull())
        return F.map_concat(rest, own)

    def of_locale(locale: Column, inner: Column) -> Column:
        last, maiden, spouse = get(inner, "last_name"), get(inner, "maiden_name"), F.coalesce(F.try_element_at("spouse_names", locale), F.col("spouse_last"))
        return F.when(copy(last, maiden), put(inner, last, last)).when(swap(last, maiden, spouse), put(inner, maiden, last)).otherwise(inner)

    last, maiden, spouse = F.col("last"), F.col("maiden"), F.col("spouse_last")
    return df.withColumns({
        "last": F.when(swap(last, maiden, spouse), maiden).otherwise(last),
        "maiden": F.when(copy(last, maiden) | swap(last, maiden, spouse), last).otherwise(maiden),
        "names": F.transform_values("names", of_locale),
    })

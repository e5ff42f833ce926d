"""Name repair over locales: a profile's names by locale and field, mended by an ordered list of stages.

A profile has first, middle, last, maiden, suffix and names, a map of locale to a map of field to value. Stages are expressions over
the whole map, so a profile's names never leave its row; what each stage changed is told by comparing the maps before and after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locales, names

ENGLISH, SHORT, RUSSIAN, UKRAINIAN, HEBREW = "en-US", "en", "ru", "uk", "he"
MAP = "map<string,map<string,string>>"
#: Fields of a locale and the profile's own columns for them; which locale keeps a value that several have.
FIELDS = ("first_name", "middle_name", "last_name", "maiden_name", "suffix", "title")
PRIMARY = {"first_name": "first", "last_name": "last", "maiden_name": "maiden", "middle_name": "middle"}
PRIORITY = {"en-US": 100, "ru": 90, "uk": 85, "he": 80, "lt": 70, "et": 70, "lv": 70, "pl": 70, "de": 70, "fr": 60, "es": 60, "pt": 60, "it": 60}
LATIN_LOCALES = ("lt", "et", "lv", "pl", "de", "fr", "es", "pt", "it")
CYRILLIC_LOCALES = ("ru", "uk", "be", "bg", "sr", "mk", "kk", "ky")


def _empty() -> Column:
    return F.from_json(F.lit("{}"), "map<string,string>")


def fields_of(names_: Column, locale: str) -> Column:
    return F.coalesce(F.element_at(names_, F.lit(locale)), _empty())


def with_fields(names_: Column, locale: str, inner: Column) -> Column:
    """The map with that locale's fields replaced."""
    rest = F.map_filter(names_, lambda k, _: k != locale)
    return F.map_from_entries(F.concat(F.map_entries(rest), F.array(F.struct(F.lit(locale).alias("key"), inner.alias("value")))))


def solid(inner: Column) -> Column:
    return F.map_filter(inner, lambda _, v: F.length(F.trim(v)) > 0)


def fill(inner: Column, more: Column) -> Column:
    """inner with what more has and inner lacks. inner is worked out once, so that chains of fills don't double at each step."""
    return F.get(F.transform(F.array(solid(inner)), lambda kept: F.map_concat(kept, F.map_filter(solid(more), lambda k, _: ~F.map_contains_key(kept, k)))), F.lit(0))


def primary() -> Column:
    """The profile's own values by field."""
    return solid(F.map_from_arrays(F.array(*[F.lit(f) for f in PRIMARY]), F.array(*[F.col(c) for c in PRIMARY.values()])))


def _mapped(inner: Column, test, value) -> Column:
    """value(v) of the fields whose value passes the test."""
    return solid(F.transform_values(F.map_filter(solid(inner), lambda _, v: test(v)), lambda _, v: value(v)))


def script_split(df: DataFrame) -> DataFrame:
    """Values of mixed scripts: the Cyrillic words fill ru, the Hebrew ones he, the Latin ones stay in an English locale or else fill en-US."""
    mixed = lambda v: names.script(v) == "Mixed"
    # each value with its words by script, null unless mixed: the dear part, made once
    parts = lambda m: F.transform_values(m, lambda _, v: F.struct(v.alias("v"), F.when(mixed(v), names.split_by_script(v)).alias("p")))
    df = df.withColumns({"__read": F.transform_values("names", lambda _, m: parts(m)), "__own": parts(primary())})
    every = F.concat(F.map_values("__read"), F.array(F.col("__own")))
    part = lambda m, k: solid(F.transform_values(F.map_filter(m, lambda _, x: x["p"].isNotNull()), lambda _, x: x["p"][k]))
    found = lambda k, start: F.aggregate(every, start, lambda acc, m: fill(acc, part(m, k)))
    latin = lambda x: x["p"]["latin"]
    kept = F.transform_values("__read", lambda loc, m: F.transform_values(F.map_filter(m, lambda _, x: loc.isin(ENGLISH, SHORT) | latin(x).isNull()), lambda _, x: F.coalesce(latin(x), x["v"])))
    df = df.withColumns({"__ru": found("cyrillic", fields_of(F.col("names"), RUSSIAN)), "__he": found("hebrew", fields_of(F.col("names"), HEBREW)), "__en": found("latin", _empty()), "__kept": kept})
    # values that were mixed in ru and he are gone from kept, so what was found fills them
    for locale, column in ((RUSSIAN, "__ru"), (HEBREW, "__he"), (ENGLISH, "__en")):
        df = df.withColumn("__kept", with_fields(F.col("__kept"), locale, fill(F.map_filter(fields_of(F.col("__kept"), locale), lambda _, v: ~mixed(v)), _mapped(F.col(column), lambda v: ~mixed(v), lambda v: v))))
    own = {c: F.coalesce(F.try_element_at("__own", F.lit(f))["p"]["latin"], F.col(c)) for f, c in PRIMARY.items()}
    return df.withColumns(own | {"names": F.col("__kept")}).drop("__read", "__own", "__ru", "__he", "__en", "__kept")


def cyrillic_to_ru(df: DataFrame) -> DataFrame:
    """Purely Cyrillic values leave the English locales; where ru has none they go there, as do the profile's own."""
    pure = lambda v: names.is_purely(v, "Cyrillic")
    same = lambda v: v
    ru = fields_of(F.col("names"), RUSSIAN)
    for inner in (fields_of(F.col("names"), ENGLISH), fields_of(F.col("names"), SHORT), primary()):
        ru = fill(ru, _mapped(inner, pure, same))
    kept = F.transform_values("names", lambda loc, m: F.when(loc.isin(ENGLISH, SHORT), F.map_filter(m, lambda _, v: ~F.coalesce(pure(v), F.lit(False)))).otherwise(m))
    df = df.withColumns({"__ru": ru, "__kept": kept})
    return df.withColumn("names", with_fields(F.col("__kept"), RUSSIAN, F.col("__ru"))).drop("__ru", "__kept")


def copied(target: str, test, value=lambda v: v, sources: tuple[str, ...] | None = (ENGLISH, SHORT, RUSSIAN), cyrillic: bool = False, own: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A stage that fills a locale with the values of others, and the profile's own, that are of its language. sources None: all."""

    def stage(df: DataFrame) -> DataFrame:
        fits = lambda v: F.coalesce((F.lit(True) if cyrillic else ~names.contains(v, "Cyrillic")) & test(v), F.lit(False))
        start = fields_of(F.col("names"), target)
        others = F.map_values(F.map_filter("names", lambda k, _: k != target)) if sources is None else F.array(*[fields_of(F.col("names"), s) for s in sources if s != target])
        every = F.concat(others, F.array(primary())) if own else others
        found = F.aggregate(every, start, lambda acc, m: fill(acc, _mapped(m, fits, value)))
        df = df.withColumn("__found", found)
        return df.withColumn("names", F.when((F.cardinality("__found") > 0) | F.map_contains_key("names", F.lit(target)), with_fields(F.col("names"), target, F.col("__found"))).otherwise(F.col("names"))).drop("__found")

    return stage


def latin_languages(df: DataFrame) -> DataFrame:
    for locale in ("lv", "pl", "de"):
        df = copied(locale, lambda v, locale=locale: names.latin_language(v) == locale, sources=(ENGLISH, SHORT), own=False)(df)
    return df


def transliterated(df: DataFrame) -> DataFrame:
    """en-US is filled from ru, then uk; the profile's own purely Cyrillic values become en-US's, or are romanised."""
    has = lambda v: names.contains(v, "Cyrillic")
    en = fields_of(F.col("names"), ENGLISH)
    for source in (RUSSIAN, UKRAINIAN):
        en = fill(en, _mapped(fields_of(F.col("names"), source), has, locales.romanise))
    df = df.withColumn("__en", en)
    df = df.withColumn("names", F.when(F.cardinality("__en") > 0, with_fields(F.col("names"), ENGLISH, F.col("__en"))).otherwise(F.col("names")))
    latin = lambda f, c: F.when(names.is_purely(F.element_at("__en", f), "Latin"), F.element_at("__en", f)).otherwise(locales.romanise(F.col(c)))
    own = {c: F.when(names.is_purely(F.col(c), "Cyrillic"), latin(f, c)).otherwise(F.col(c)) for f, c in PRIMARY.items()}
    return df.withColumns(own).drop("__en")


def ensure_english(df: DataFrame) -> DataFrame:
    """en-US has every field that some locale or the profile has, in ASCII; the profile's own values are ASCII."""
    en, whole = fields_of(F.col("names"), ENGLISH), lambda v: F.lit(True)
    for source in (RUSSIAN, UKRAINIAN):
        en = fill(en, _mapped(fields_of(F.col("names"), source), whole, locales.romanise))
    for source in ("lt", "et", "lv", "pl", "de", SHORT):
        en = fill(en, _mapped(fields_of(F.col("names"), source), lambda v: names.is_purely(v, "Latin"), names.remove_diacritics))
    own = solid(F.map_concat(primary(), F.map_filter(F.create_map(F.lit("suffix"), F.col("suffix")), lambda _, v: v.isNotNull())))
    en = fill(en, _mapped(own, lambda v: names.is_purely(v, "Latin") | names.is_purely(v, "Cyrillic"), locales.to_ascii))
    df = df.withColumn("__en", en)
    simple = F.transform_values("__en", lambda _, v: F.when(locales.is_basic_latin(v), v).when(names.contains(v, "Cyrillic"), locales.to_ascii(v)).otherwise(names.remove_diacritics(v)))
    df = df.withColumn("names", F.when(F.cardinality("__en") > 0, with_fields(F.col("names"), ENGLISH, simple)).otherwise(F.col("names"))).drop("__en")
    return df.withColumns({c: F.when(locales.is_basic_latin(F.col(c)), F.col(c)).otherwise(locales.to_ascii(F.col(c))) for c in PRIMARY.values()})


def without_duplicates(df: DataFrame) -> DataFrame:
    """A value that several locales have in one field stays where its priority is highest, unless its language or script makes it another."""
    plain = lambda v: names.remove_diacritics(F.lower(F.trim(v)))

    def rank(loc: Column, v: Column) -> Column:
        base = F.lit(50)
        for name, points in PRIORITY.items():
            base = F.when(loc == name, points).otherwise(base)
        fits = F.when(loc.isin(RUSSIAN, UKRAINIAN), names.contains(v, "Cyrillic")).when(loc == HEBREW, names.contains(v, "Hebrew")).when(loc.isin(ENGLISH, "lt", "et", "lv", "pl", "de", "fr"), names.contains(v, "Latin")).otherwise(True)
        return base + F.when(fits, 10).otherwise(0)

    # every value: its field, locale, rank (ties: first locale by name) and comparison form
    flat = F.flatten(F.transform(F.map_entries("names"), lambda e: F.transform(F.map_entries(solid(e["value"])), lambda x: F.struct(x["key"].alias("f"), e["key"].alias("loc"), x["value"].alias("v"), rank(e["key"], x["value"]).alias("rank"), plain(x["value"]).alias("p")))))
    df = df.withColumn("__flat", flat)

    def goes(loc: Column, f: Column, v: Column) -> Column:
        group = F.filter("__flat", lambda x: (x["f"] == f) & (x["p"] == plain(v)))
        best = F.get(F.array_sort(group, lambda a, b: F.when(a["rank"] > b["rank"], -1).when(a["rank"] < b["rank"], 1).when(a["loc"] < b["loc"], -1).otherwise(1)), F.lit(0))
        both = loc.isin(*CYRILLIC_LOCALES) & best["loc"].isin(*CYRILLIC_LOCALES)
        marked = loc.isin(*LATIN_LOCALES) & best["loc"].isin(ENGLISH, SHORT) & v.rlike("[\\x{00C0}-\\x{024F}]")
        scripts = names.contains(best["v"], "Cyrillic") != names.contains(v, "Cyrillic")
        return F.coalesce((F.size(group) > 1) & (best["loc"] != loc) & ~both & ~marked & ~scripts, F.lit(False))

    return df.withColumn("names", F.transform_values("names", lambda loc, m: F.map_filter(m, lambda f, v: ~goes(loc, f, v)))).drop("__flat")


def cleaned(df: DataFrame) -> DataFrame:
    """Values trimmed, blank ones and empty locales dropped, `en` without what en-US says too."""
    trimmed = F.transform_values("names", lambda _, m: solid(F.transform_values(m, lambda _, v: F.trim(v))))
    df = df.withColumn("names", trimmed)
    us = fields_of(F.col("names"), ENGLISH)
    single = F.transform_values("names", lambda loc, m: F.when(loc == SHORT, F.map_filter(m, lambda f, v: ~F.coalesce(F.lower(F.element_at(us, f)) == F.lower(v), F.lit(False)))).otherwise(m))
    return df.withColumn("names", F.map_filter(single, lambda _, m: F.cardinality(m) > 0))


STAGES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ScriptSplit": script_split,
    "CyrillicToRu": cyrillic_to_ru,
    "Ukrainian": copied(UKRAINIAN, names.is_ukrainian, sources=None, cyrillic=True),
    "Lithuanian": copied("lt", lambda v: names.latin_language(v) == "lt"),
    "Estonian": copied("et", lambda v: names.latin_language(v) == "et"),
    "LatinLanguage": latin_languages,
    "Hebrew": copied(HEBREW, lambda v: names.contains(v, "Hebrew"), lambda v: F.trim(F.regexp_replace(v, r"[^\x{0590}-\x{05FF}\s'-]", "")), sources=None, cyrillic=True),
    "Translit": transliterated,
    "EnsureEnglish": ensure_english,
    "DuplicateRemoval": without_duplicates,
    "Cleanup": cleaned,
}


def fix(df: DataFrame, stages: tuple[str, ...] = tuple(STAGES)) -> DataFrame:
    """The profiles with the stages applied, in order."""
    for name in STAGES:
        if name in stages:
            df = STAGES[name](df)
    return df


def values(names_: Column) -> Column:
    """array<struct<locale, field, value>> of all values."""
    return F.flatten(F.transform(F.map_entries(names_), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(e["key"].alias("locale"), x["key"].alias("field"), x["value"].alias("value")))))


def changes(df: DataFrame, stages: tuple[str, ...] = tuple(STAGES)) -> DataFrame:
    """id, handler, locale (null: the profile's own), field, old_value and new_value of what each stage changed."""
    state = lambda d: F.map_from_entries(F.concat(F.transform(values(F.col("names")), lambda x: F.struct(F.struct(x["locale"].alias("locale"), x["field"].alias("field")).alias("key"), x["value"].alias("value"))), F.transform(F.map_entries(primary()), lambda x: F.struct(F.struct(F.lit(None).cast("string").alias("locale"), x["key"].alias("field")).alias("key"), x["value"].alias("value")))))
    df = df.withColumn("__s0", state(df))
    used = [n for n in STAGES if n in stages]
    for i, name in enumerate(used):
        df = STAGES[name](df)
        df = df.withColumn(f"__s{i + 1}", state(df))

    def told(i: int, name: str) -> Column:
        old, new = F.col(f"__s{i}"), F.col(f"__s{i + 1}")
        keys = F.array_union(F.map_keys(old), F.map_keys(new))
        rows = F.transform(keys, lambda k: F.struct(F.lit(name).alias("handler"), k["locale"].alias("locale"), k["field"].alias("field"), F.element_at(old, k).alias("old_value"), F.element_at(new, k).alias("new_value")))
        return F.filter(rows, lambda r: ~r["old_value"].eqNullSafe(r["new_value"]))

    return df.select("id", F.explode(F.concat(*[told(i, n) for i, n in enumerate(used)])).alias("e")).select("id", "e.*")

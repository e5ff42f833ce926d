"""Field differences of matched people and the payloads made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: Compared fields and the columns that hold them.
TEXTS = {
    "FirstName": "first", "LastName": "last", "MaidenName": "maiden", "MiddleName": "middle", "Nickname": "nickname", "Suffix": "suffix",
    "BirthPlace": "birth_place", "DeathPlace": "death_place", "BurialPlace": "burial_place",
}
DATES = {"BirthDate": "birth_date", "DeathDate": "death_date", "BurialDate": "burial_date"}
#: A payload's keys of those fields.
KEYS = {"FirstName": "first_name", "MiddleName": "middle_name", "LastName": "last_name", "MaidenName": "maiden_name", "Suffix": "suffix", "Nickname": "nicknames", "Occupation": "occupation"}
PHOTO_ACTIONS = ("AddPhoto", "UpdatePhoto", "PhotoMatch")
#: Photos at least as similar are the same picture.
SAME_PHOTO = 0.98


def added_fields(src: DataFrame, dst: DataFrame, mapping: DataFrame, fields: list[str]) -> DataFrame:
    """src_id, dst_id, field, new_value and action of what the source has and the target lacks. People are joined once, then unpivoted."""
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), *[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(f"{p}_{c}") for c in fields])
    rows = mapping.select("src_id", "dst_id").join(side(src, "src"), "src_id").join(side(dst, "dst"), "dst_id")
    found = F.array(*[F.when(F.col(f"src_{c}").isNotNull() & F.col(f"dst_{c}").isNull(), F.struct(F.lit(c).alias("field"), F.col(f"src_{c}").alias("new_value"), F.lit("Add").alias("action"))) for c in fields])
    return rows.select("src_id", "dst_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select("src_id", "dst_id", "e.*")


def solid(text: Column) -> Column:
    """Without white space at its ends; null where nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def update_payload(diffs: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """dst_id, n_fields and payload (JSON by field) of every person with a difference."""
    rows = diffs.where(~F.col("field").isin(*skip)) if skip else diffs
    entries = F.array_sort(F.collect_list(F.struct("field", "new_value")))
    return rows.groupBy("dst_id").agg(F.to_json(F.map_from_entries(entries)).alias("payload"), F.count("*").alias("n_fields"))


def date_action(src_precision, dst_precision):
    """Add a missing date, Update one that is less precise, else null."""
    return F.when(src_precision.isNull(), F.lit(None).cast("string")).when(dst_precision.isNull(), "Add").when(src_precision > dst_precision, "Update")


def differences(src: DataFrame, dst: DataFrame, mapping: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """src_id, dst_id, field, src_value, dst_value and action of each of 14 fields that the source tells and the target doesn't.

    People have id, gender, photos (array of addresses) and the columns of TEXTS and DATES. Texts and genders are added where the target has none; a birth name isn't where it is the
    target's surname in any case. Dates are added, or updated by more precise ones. Of new photos the first is told. Nulls and blanks are no values. The people are joined once each.
    """
    wanted = [*TEXTS.values(), *DATES.values(), "gender", "photos"]
    # how precise a date is is worked out once a person, before the join
    exact = [dates.parse(F.col(c))["precision"].alias(f"{c}_precision") for c in DATES.values()]
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), F.struct(*wanted, *exact).alias(p))
    rows = mapping.select("src_id", "dst_id").join(side(src, "src"), "src_id").join(side(dst, "dst"), "dst_id")
    s, d = (lambda c: F.col(f"src.{c}")), (lambda c: F.col(f"dst.{c}"))
    none = F.lit(None).cast("string")

    def told(field: str, src_value: Column, dst_value: Column, action: Column) -> Column:
        return F.when(action.isNotNull(), F.struct(F.lit(field).alias("field"), src_value.alias("src_value"), dst_value.alias("dst_value"), action.alias("action")))

    found = []
    for field, c in TEXTS.items():
        new = solid(s(c)).isNotNull() & solid(d(c)).isNull()
        if field == "MaidenName":
            new &= ~F.coalesce(F.lower(solid(s(c))) == F.lower(solid(d("last"))), F.lit(False))
        found.append(told(field, solid(s(c)), none, F.when(new, "Add")))
    for field, c in DATES.items():
        action = date_action(s(f"{c}_precision"), d(f"{c}_precision"))
        found.append(told(field, s(c), F.when(action == "Update", d(c)), action))
    known = lambda c: F.coalesce(c, F.lit("Unknown")) != "Unknown"
    found.append(told("Gender", s("gender"), none, F.when(known(s("gender")) & ~known(d("gender")), "Add")))
    photos = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    fresh = F.get(F.array_except(photos(s("photos")), photos(d("photos"))), F.lit(0))
    found.append(told("PhotoUrl", fresh, F.get(photos(d("photos")), F.lit(0)), F.when(fresh.isNotNull(), "AddPhoto")))
    out = rows.select("src_id", "dst_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e")).select("src_id", "dst_id", "e.*")
    return out.where(~F.col("field").isin(*ignore)) if ignore else out


def photo_differences(matches: DataFrame, first: DataFrame) -> DataFrame:
    """src_id, dst_id, field, src_value, dst_value, action and similarity of photos compared by content.

    matches: src_id, dst_id, src_url, dst_url (null: nothing is like it), similarity; first: dst_id, url of each target's first photo. What nothing is like is added, what is alike
    but not the same picture updates it.
    """
    action = F.when(F.col("dst_url").isNull(), "AddPhoto").when(F.col("similarity") < SAME_PHOTO, "UpdatePhoto")
    rows = matches.withColumn("action", action).where("action is not null").join(first.select("dst_id", "url"), "dst_id", "left")
    return rows.select("src_id", "dst_id", F.lit("PhotoUrl").alias("field"), F.col("src_url").alias("src_value"), F.coalesce("dst_url", "url").alias("dst_value"), "action", "similarity")


def identical(mapping: DataFrame, diffs: DataFrame) -> DataFrame:
    """Pairs of the mapping without any difference."""
    return mapping.join(diffs.select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti")


def usable(people: DataFrame) -> DataFrame:
    """People with a given name or a surname."""
    return people.where(F.coalesce(solid(F.col("first")), solid(F.col("last"))).isNotNull())


def service_gender(gender: Column) -> Column:
    return F.when(F.upper(gender).isin("M", "MALE"), "male").when(F.upper(gender).isin("F", "FEMALE"), "female")


def _event(has: Column, date: Column, place: Column) -> Column:
    return F.when(has, F.struct(date.alias("date"), F.when(place.isNotNull(), F.struct(place.alias("place_name"))).alias("location")))


def service_payloads(diffs: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """src_id, dst_id, n_fields and payload: one update of a profile with all its fields, photos and skipped ones left out.

    Fields are folded by an aggregate, so no list of them is built. A date that can't be read leaves an empty event; a pair whose fields are all blank or unknown gives no row.
    """
    rows = diffs.where(~F.col("action").isin(*PHOTO_ACTIONS) & ~F.col("field").isin(*skip, "") & (F.length("src_value") > 0))
    fields = [*KEYS, "Gender", *(f"{e}{p}" for e in ("Birth", "Death", "Burial") for p in ("Date", "Place"))]
    wide = rows.where(F.col("field").isin(*fields)).groupBy("src_id", "dst_id").agg(F.count("*").alias("n_fields"), *[F.max(F.when(F.col("field") == f, F.col("src_value"))).alias(f) for f in fields])
    event = lambda e: _event(F.coalesce(f"{e}Date", f"{e}Place").isNotNull(), dates.update_form(F.col(f"{e}Date")), F.col(f"{e}Place")).alias(e.lower())
    body = F.struct(*[F.col(f).alias(k) for f, k in KEYS.items()], service_gender(F.col("Gender")).alias("gender"), event("Birth"), event("Death"), event("Burial"))
    return wide.select("src_id", "dst_id", "n_fields", F.to_json(body).alias("payload"))


def creation_payloads(people: DataFrame) -> DataFrame:
    """id and payload of a new profile; it is alive if no date of death is given. Blank events are left out."""
    event = lambda e: _event(F.coalesce(solid(F.col(f"{e}_date")), solid(F.col(f"{e}_place"))).isNotNull(), dates.creation_form(solid(F.col(f"{e}_date"))), F.when(solid(F.col(f"{e}_place")).isNotNull(), F.col(f"{e}_place"))).alias(e)
    names = [F.col(TEXTS[f]).alias(KEYS[f]) for f in ("FirstName", "MiddleName", "LastName", "MaidenName", "Suffix", "Nickname")]
    alive = (F.coalesce(F.length("death_date"), F.lit(0)) == 0).alias("is_alive")
    return people.select("id", F.to_json(F.struct(*names, service_gender(F.col("gender")).alias("gender"), event("birth"), event("death"), event("burial"), alive)).alias("payload"))

"""GEDCOM reader. A file is cut at its records, so many tasks read one large file; a record is one row, and its people and families are expressions over its lines.

Records are numbered in file order by two running counts: rows inside a split of the file, and rows of the splits before it.
A line without level and tag inside a NOTE is the note's next line. Lines end in \\n or \\r\\n. A file's encoding is UTF-8, or UTF-16 if its first bytes say so.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..scratch import Scratch
from ..shipping import ship

_LINE = re.compile(r"^\s*(\d+)\s+(?:(@[^@]+@)\s+)?([A-Za-z_]\w*)(?:\s(.*))?$")
LINES = "array<struct<top int, path string, value string>>"
#: Tags of an individual that the standard knows; others are kept by name.
KNOWN = "NAME SEX BIRT CHR DEAT BURI CREM ADOP BAPM BARM BASM BLES CHRA CONF FCOM ORDN NATU EMIG IMMI CENS PROB WILL GRAD RETI EVEN CAST DSCR EDUC IDNO NATI NCHI NMR OCCU PROP RELI RESI SSN TITL FACT FAMC FAMS SUBM ASSO ALIA ANCI DESI RFN AFN REFN CHAN NOTE SOUR OBJE RESN BAPL CONL ENDL SLGC".split()
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
#: Endings of a woman's surname and of her husband's.
PAIRS = (("ова", "ов"), ("ева", "ев"), ("ина", "ин"), ("ына", "ын"), ("ская", "ский"), ("цкая", "цкий"))


def parse_record(text: str | None) -> tuple[str | None, str | None, list[tuple[int, str, str | None]]]:
    """(id, tag, lines) of a record: lines are (number of the line of level 1 that it belongs to, path of tags below the record, value).

    CONT and CONC join the line that they stand below. A note goes on until a tag of its level or a smaller one.
    """
    mark = kind = None
    out: list[list] = []
    stack: list[tuple[str, list | None]] = []
    note: tuple[int, list] | None = None
    for raw in re.split(r"\r?\n", (text or "").rstrip("\r")):
        if not raw.strip():
            continue
        found = _LINE.match(raw)
        if not found:
            if note:
                note[1][2] = (note[1][2] or "") + "\n" + raw
            continue
        level, tag, value = min(int(found[1]), len(stack)), found[3].upper(), found[4]
        if tag in ("CONT", "CONC"):
            row = stack[level - 1][1] if 0 < level <= len(stack) else None
            if row is not None:
                row[2] = (row[2] or "") + ("\n" if tag == "CONT" else "") + (value or "")
            continue
        if note and level <= note[0]:
            note = None
        if level == 0:
            mark, kind, stack = found[2], tag, [(tag, None)]
            continue
        row = [len(out), ".".join([*(t for t, _ in stack[1:level]), tag]), value]
        row[0] = row[0] if level == 1 else stack[1][1][0]
        stack[level:] = [(tag, row)]
        out.append(row)
        if tag == "NOTE":
            note = (level, row)
    return mark, kind, [tuple(x) for x in out]


def _parsed(text: Column) -> Column:
    @F.pandas_udf(f"id string, tag string, lines {LINES}")
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(i, t, [{"top": a, "path": b, "value": c} for a, b, c in rows]) for i, t, rows in map(parse_record, texts)], columns=["id", "tag", "lines"])

    return parse(text)


def encoding(spark: SparkSession, path: str) -> str:
    """UTF-8, or UTF-16 in the order of the first file's byte order mark."""
    first = spark.read.text(path).select(F.hex(F.substring(F.col("value").cast("binary"), 1, 2)).alias("h")).first()
    return {"FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}.get(first["h"] if first else "", "UTF-8")


def read_records(spark: SparkSession, path: str, tree: str, scratch: Scratch | None = None) -> DataFrame:
    """tree, record (its number in the file), id, tag and lines of every record; several files follow each other by name."""
    ship(spark)
    scratch = scratch or Scratch(spark, "gedcom")
    charset = encoding(spark, path)
    rows = spark.read.option("encoding", charset).option("lineSep", "\n0 ").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    # bytes that are no UTF-8 are replaced
    text = F.make_valid_utf8("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    text = F.regexp_replace(text, "^\ufeff", "")
    # the separator takes the level of all records but a file's first
    text = F.when(text.rlike(r"^\s*0\s"), text).otherwise(F.concat(F.lit("0 "), text))
    rows = scratch.keep(rows.withColumn("p", _parsed(text)).select("file", "at", "n", "p.*"), "records")
    # splits of files, not their rows, are put in order
    splits = rows.groupBy("file", "at").agg(F.min("n").alias("first"), (F.max("n") - F.min("n") + 1).alias("size"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("at")) - F.col("size") - F.col("first")
    return rows.join(splits.select("file", "at", before.alias("before")), ["file", "at"]).select(F.lit(tree).alias("tree"), "file", (F.col("n") + F.col("before")).alias("record"), "id", "tag", "lines")


def read_lines(spark: SparkSession, path: str, tree: str) -> DataFrame:
    """tree, file, record, id, tag, pos, path and value of every line below a record."""
    return read_records(spark, path, tree).select("tree", "file", "record", "id", "tag", F.posexplode("lines").alias("pos", "l")).select("tree", "file", "record", "id", "tag", "pos", F.concat_ws(".", "tag", "l.path").alias("path"), "l.value")


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def variants(name: Column) -> Column:
    """`A (B)` and `A\\B` are two spellings; anything but letters, digits, blanks, hyphens and apostrophes goes."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{M}0-9 '-]", ""), r"\s+", " "))
    both = lambda n, p: F.array(clean(F.regexp_extract(n, p, 1)), clean(F.regexp_extract(n, p, 2)))
    round_, slash = r"^(.+?)\s*\(([^)]+)\)\s*$", r"^(.+?)\\(.+)$"
    found = lambda n: F.when(n.rlike(round_), both(n, round_)).when(n.rlike(slash), both(n, slash)).otherwise(F.array(clean(n)))
    return names.once(name, lambda n: F.when(_filled(n).isNull(), F.array().cast("array<string>")).otherwise(F.filter(found(n), lambda x: x != "")))


def clean_name(name: Column) -> Column:
    return F.get(variants(name), F.lit(0))


def date(text: Column) -> Column:
    """struct(year, month, day, precision): the first date of a range; an impossible day leaves the month, an unknown month the year; null without a year."""
    body = F.regexp_replace(F.upper(F.trim(text)), r"^(ABT|BEF|AFT|EST|CAL|BET|FROM|TO|INT)\.?\s+", "")
    body = F.regexp_replace(F.regexp_replace(body, r"\s+(AND|TO)\s.*$", ""), r"\s*\(.*$", "")
    part = lambda b, i: F.nullif(F.regexp_extract(b, r"^(?:([0-9]{1,2})\s+)?(?:([A-Z]{3})\s+)?([0-9]{1,4})(?:/[0-9]{2})?\s*$", i), F.lit(""))
    month_of = lambda b: F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(b, 2)).cast("int"), F.lit(0))
    parts = lambda b: F.struct(F.nullif(part(b, 3).cast("int"), F.lit(0)).alias("year"), month_of(b).alias("month"), part(b, 1).cast("int").alias("day"))

    def dated(p: Column) -> Column:
        last = F.dayofmonth(F.last_day(F.make_date(F.coalesce(p["year"], F.lit(1)), F.coalesce(p["month"], F.lit(1)), F.lit(1))))
        whole = p["month"].isNotNull() & p["day"].between(1, 31) & (p["day"] <= last)
        found = F.struct(p["year"].alias("year"), p["month"].alias("month"), F.when(whole, p["day"]).alias("day"), F.when(whole, 2).when(p["month"].isNotNull(), 1).otherwise(0).alias("precision"))
        return F.when(p["year"].isNotNull(), found)

    return names.once(names.once(body, parts), dated)


def persons(records: DataFrame, this_year: Column | None = None) -> DataFrame:
    """Every individual: names, gender, events, attributes, links, notes, other tags; no shuffle but for the addresses of linked media.

    living is false with a death, true for births less than 120 years before this_year (today's by default), else null.
    """
    rows = records.where("tag = 'INDI' and id is not null")
    all_of = lambda path, lines="lines": F.filter(lines, lambda x: x["path"] == path)
    value = lambda path: F.get(all_of(path), F.lit(0))["value"]
    below = lambda group, path: F.get(F.filter("lines", lambda x: (x["path"] == path) & (x["top"] == group["top"])), F.lit(0))["value"]
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    pieces = {"given": "GIVN", "surname": "SURN", "nick": "NICK", "suffix": "NSFX", "prefix": "SPFX", "type": "TYPE", "married": "_MARNM"}
    rows = rows.withColumns({
        "names": F.transform(all_of("NAME"), lambda n: F.struct(n["value"].alias("whole"), *[below(n, f"NAME.{tag}").alias(c) for c, tag in pieces.items()])),
        # of an event told several times the last counts
        **{e: F.struct(below(last(all_of(tag)), f"{tag}.DATE").alias("date"), below(last(all_of(tag)), f"{tag}.PLAC").alias("place")) for e, tag in (("birth", "BIRT"), ("death", "DEAT"), ("burial", "BURI"))},
        "homes": F.transform(all_of("RESI"), lambda r: F.struct(*[below(r, f"RESI.{t}").alias(c) for c, t in (("place", "PLAC"), ("line", "ADDR"), ("city", "ADDR.CITY"), ("state", "ADDR.STAE"), ("country", "ADDR.CTRY"))])),
    })
    primary = F.get("names", F.lit(0))
    rows = rows.withColumns({"g": clean_name(primary["given"]), "s": clean_name(primary["surname"])})
    bare = F.col("g").isNull() & F.col("s").isNull()
    whole = lambda i: clean_name(F.regexp_extract(F.when(_filled(primary["whole"]).isNotNull(), primary["whole"]), "^([^/]*?)/?([^/]*)?/?$", i))
    words = F.split("g", " ")
    typed = lambda *kinds: last(F.filter(F.transform(F.filter("names", lambda n: F.upper(n["type"]).isin(*kinds)), lambda n: clean_name(n["surname"])), lambda x: x.isNotNull()))
    rows = rows.withColumns({
        "first": F.when(bare, whole(1)).when(F.size(words) == 2, words[0]).otherwise(F.col("g")), "middle": F.when(F.size(words) == 2, words[1]),
        "last": F.coalesce(typed("MARRIED"), F.when(bare, whole(2)).otherwise(F.col("s"))), "maiden": F.coalesce(typed("MAIDEN", "BIRTH"), clean_name(primary["prefix"])), "marnm": _filled(primary["married"]),
    })
    taken = F.col("marnm").isNotNull() & F.col("last").isNotNull() & F.col("maiden").isNull() & (F.lower("marnm") != F.lower("last"))
    own = F.concat(variants(primary["given"]), variants(primary["surname"]), variants(primary["nick"]))
    lower_once = F.aggregate(own, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))
    others = F.flatten(F.transform("names", lambda n: F.concat(variants(n["given"]), variants(n["surname"]))))
    # a home counts until one has a city
    home = F.aggregate("homes", F.lit(None).cast("struct<place string, line string, city string, state string, country string>"), lambda acc, x: F.when(acc["city"].isNotNull(), acc).otherwise(F.struct(F.coalesce(x["place"], acc["place"]).alias("place"), x["line"].alias("line"), x["city"].alias("city"), x["state"].alias("state"), x["country"].alias("country"))))
    other = F.filter("lines", lambda x: ~x["path"].contains(".") & ~x["path"].isin(*KNOWN))
    stored = F.filter(other, lambda x: ~x["path"].isin("EMAIL", "WWW"))
    tags = F.map_from_entries(F.transform(F.array_distinct(F.transform(stored, lambda x: x["path"])), lambda t: F.struct(t, F.array_join(F.transform(F.filter(stored, lambda x: x["path"] == t), lambda x: F.coalesce(x["value"], F.lit(""))), "\n"))))
    mail = F.get(F.filter(other, lambda x: (x["path"] == "EMAIL") | ((x["path"] == "ADDR") & x["value"].contains("@"))), F.lit(0))["value"]
    texts = lambda path: F.transform(all_of(path), lambda x: F.trim(x["value"]))
    birth, death = date(F.col("birth.date")), date(F.col("death.date"))
    sex, year = F.upper(value("SEX")), this_year if this_year is not None else F.year(F.current_date())
    out = rows.withColumns({"b": birth, "d": death}).select(
        "tree", "record", "id", "first", "middle", F.when(taken | F.col("last").isNull(), F.coalesce("marnm", "last")).otherwise(F.col("last")).alias("last"), F.when(taken, F.col("last")).otherwise(F.col("maiden")).alias("maiden"),
        clean_name(primary["nick"]).alias("nickname"), clean_name(primary["suffix"]).alias("suffix"), F.array_union(lower_once, others).alias("variants"), F.when(sex == "M", "Male").when(sex == "F", "Female").otherwise("Unknown").alias("gender"),
        *[F.col(f"{c}.{p}").alias(f"{e}_{p}") for e, c in (("birth", "b"), ("death", "d")) for p in ("year", "month", "day")], F.col("birth.date").alias("birth_date"), F.col("birth.place").alias("birth_place"), F.col("death.date").alias("death_date"), F.col("death.place").alias("death_place"),
        F.col("burial.date").alias("burial_date"), F.col("burial.place").alias("burial_place"), F.when(F.size(all_of("DEAT")) > 0, False).when(F.col("b.year") > year - 120, True).alias("living"),
        F.get(F.filter(texts("OCCU"), lambda x: x.isNotNull()), F.lit(0)).alias("occupation"), home["city"].alias("residence_city"), home["state"].alias("residence_state"), home["country"].alias("residence_country"), F.coalesce(home["place"], home["line"]).alias("residence_address"),
        texts("FAMC").alias("child_of"), texts("FAMS").alias("spouse_of"), value("RFN").alias("profile_id"), F.filter(texts("NOTE"), lambda x: (x != "") & ~x.rlike("^@[^@]+@$")).alias("notes"), tags.alias("custom_tags"), mail.alias("email"), F.get(F.filter(other, lambda x: x["path"] == "WWW"), F.lit(0))["value"].alias("website"),
        F.transform(all_of("OBJE"), lambda o: F.struct(F.when(F.trim(o["value"]).rlike("^@[^@]+@$"), F.trim(o["value"])).alias("link"), F.transform(F.filter("lines", lambda x: (x["path"] == "OBJE.FILE") & (x["top"] == o["top"])), lambda x: F.trim(x["value"])).alias("files"))).alias("media"),
    )
    linked = out.select("tree", "record", F.posexplode("media").alias("pos", "m")).select("tree", "record", "pos", "m.*")
    held = records.where("tag = 'OBJE'").select("tree", F.col("id").alias("link"), F.trim(F.get(F.filter("lines", lambda x: x["path"] == "FILE"), F.lit(0))["value"]).alias("file")).dropDuplicates(["tree", "link"])
    urls = linked.join(held, ["tree", "link"], "left").select("tree", "record", "pos", F.filter(F.when(F.col("link").isNotNull(), F.array("file")).otherwise(F.col("files")), lambda x: x != "").alias("urls"))
    urls = urls.groupBy("tree", "record").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "urls"))), lambda x: x["urls"])).alias("photo_urls"))
    return out.drop("media").join(urls, ["tree", "record"], "left").withColumn("photo_urls", F.coalesce("photo_urls", F.array().cast("array<string>")))


def families(records: DataFrame) -> DataFrame:
    """tree, record, family_id, husband_id, wife_id and child_ids in order."""
    ids = lambda path: F.filter(F.transform(F.filter("lines", lambda x: x["path"] == path), lambda x: F.trim(x["value"])), lambda x: x != "")
    return records.where("tag = 'FAM' and id is not null").select("tree", "record", F.col("id").alias("family_id"), F.get(ids("HUSB"), F.lit(0)).alias("husband_id"), F.get(ids("WIFE"), F.lit(0)).alias("wife_id"), ids("CHIL").alias("child_ids"))


def parents(families_: DataFrame) -> DataFrame:
    """tree, id, father_id and mother_id; each from the last family in file order that has one."""
    rows = families_.select("tree", "record", "husband_id", "wife_id", F.explode("child_ids").alias("id"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("record")))
    return rows.groupBy("tree", "id").agg(last("husband_id").alias("father_id"), last("wife_id").alias("mother_id"))


def feminine_of(wife: Column, husband: Column) -> Column:
    """Whether a wife's surname is her husband's in its feminine form."""
    w, h = F.lower(wife), F.lower(husband)
    stem = lambda x, end: F.substr(x, F.lit(1), F.length(x) - len(end))
    out = F.lit(False)
    for woman, man in PAIRS:
        out = out | (w.endswith(woman) & h.endswith(man) & (stem(w, woman) == stem(h, man)))
    return F.coalesce(out, F.lit(False))


def people(records: DataFrame, this_year: Column | None = None) -> DataFrame:
    """persons() with father, mother, spouses, children and siblings, and the maiden names that families tell.

    Spouses and children follow the file's families. A wife without a maiden name, whose surname is neither her husband's nor its feminine form, bears her own.
    Siblings have the same father and the same mother. A person of many families (or siblings) has long lists; no list goes through one task for all.
    """
    who, fams = persons(records, this_year), families(records)
    known = who.select("tree", "id", "last")
    couple = F.array(F.struct(F.col("husband_id").alias("id"), F.col("wife_id").alias("spouse")), F.struct(F.col("wife_id").alias("id"), F.col("husband_id").alias("spouse")))
    members = fams.select("tree", "record", "child_ids", F.explode(couple).alias("m")).select("tree", "record", "child_ids", "m.*").where("id is not null")
    lists = members.groupBy("tree", "id").agg(F.array_sort(F.collect_list(F.struct("record", "spouse", "child_ids"))).alias("f"))
    lists = lists.select("tree", "id", F.filter(F.transform("f", lambda x: x["spouse"]), lambda x: x.isNotNull()).alias("spouse_ids"), F.flatten(F.transform("f", lambda x: x["child_ids"])).alias("all_children"))
    wives = fams.where("husband_id is not null and wife_id is not null").select("tree", F.col("husband_id").alias("h"), F.col("wife_id").alias("id")).join(known.select("tree", F.col("id").alias("h"), F.col("last").alias("husband_last")), ["tree", "h"])
    own = wives.join(known, ["tree", "id"]).where((F.col("last") != F.col("husband_last")) & ~feminine_of(F.col("last"), F.col("husband_last"))).select("tree", "id", F.lit(True).alias("own_name")).distinct()
    up = parents(fams)
    born = who.select("tree", "id").join(up, ["tree", "id"])
    pair = born.where("father_id is not null or mother_id is not null").withColumns({"f": F.coalesce("father_id", F.lit("")), "m": F.coalesce("mother_id", F.lit(""))})
    kin = pair.select("tree", "f", "m", "id").join(pair.select("tree", "f", "m", F.col("id").alias("other")), ["tree", "f", "m"]).where("id <> other").groupBy("tree", "id").agg(F.array_sort(F.collect_list("other")).alias("siblings"))
    none = F.array().cast("array<string>")
    out = who.join(up, ["tree", "id"], "left").join(lists, ["tree", "id"], "left").join(own, ["tree", "id"], "left").join(kin, ["tree", "id"], "left")
    maiden = F.when(F.col("own_name") & F.col("maiden").isNull() & F.col("first").isNotNull(), F.col("last")).otherwise(F.col("maiden"))
    return out.withColumns({"maiden": maiden, "spouse_ids": F.coalesce("spouse_ids", none), "child_ids": F.coalesce("all_children", none), "sibling_ids": F.coalesce("siblings", none)}).drop("own_name", "all_children", "siblings")

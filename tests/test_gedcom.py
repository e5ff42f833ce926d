"""The GEDCOM reader: rules of a record, file order, splits."""

import pytest
from pyspark.sql import functions as F

from kinweave.sources import gedcom

TEXT = """0 HEAD
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Ivan Petrovich /Sidorov/
1 SEX M
1 BIRT
2 DATE 3 MAY 1900
2 PLAC Moscow
1 DEAT
2 DATE BET 31 FEB 1970 AND 1972
1 NOTE one
2 SOUR x
lost  line

1 OCCU smith
1 FAMS @F1@
1 FAMS @F10@
0 @I2@ INDI
1 NAME Anna /Popova/
2 GIVN Анна (Anna) Ивановна
2 SURN Попова\\Popova
2 NICK Аня
2 _MARNM Сидорова
1 NAME Anna /Smith/
2 TYPE married
2 SURN Smith
1 SEX F
1 BIRT
2 DATE ABT MAR 1990
1 RESI
2 PLAC Berlin
1 RESI
2 ADDR Street 1
3 CITY Hamburg
3 CTRY Germany
1 RESI
2 ADDR
3 CITY Bremen
1 _UID a
1 _UID b
1 RIN 7
1 ADDR me@x.org
1 WWW x.org
1 RFN geni:12
1 OBJE @M1@
1 OBJE
2 FILE  http://x/2.jpg
0 @I3@ INDI
1 NAME Petr //
1 FAMC @F9@
0 @I4@ INDI
1 NAME Olga /Smirnova/
0 @I5@ INDI
1 NAME Plain Name
2 NSFX Jr.
1 NOTE first
2 CONC  half
2 CONT second
1 BIRT
2 DATE (unknown)
0 @M1@ OBJE
1 FILE http://x/1.jpg
0 @F9@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
0 @F10@ FAM
1 HUSB @I5@
1 CHIL @I3@
1 CHIL @I4@
0 @F11@ FAM
1 HUSB @I1@
1 WIFE @I4@
1 CHIL @I5@
0 TRLR
"""


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("g") / "t.ged"
    path.write_text(TEXT, encoding="utf-8")
    records = gedcom.read_records(spark, str(path), "src")
    return records, {r["id"]: r for r in gedcom.people(records, F.lit(2026)).collect()}


def test_records_keep_file_order(tree):
    records, _ = tree
    assert [r["id"] for r in records.orderBy("record").collect()] == [None, "@I1@", "@I2@", "@I3@", "@I4@", "@I5@", "@M1@", "@F9@", "@F10@", "@F11@", None]
    assert [r["record"] for r in records.orderBy("record").collect()] == list(range(11))


def test_persons(tree):
    _, people = tree
    one, two, three, five = (people[f"@I{i}@"] for i in (1, 2, 3, 5))
    assert (one["first"], one["middle"], one["last"], one["gender"], one["birth_place"], one["occupation"]) == ("Ivan Petrovich", None, "Sidorov", "Male", "Moscow", "smith")
    assert (one["birth_year"], one["birth_month"], one["birth_day"], one["death_year"], one["death_month"], one["death_day"], one["living"]) == (1900, 5, 3, 1970, 2, None, False)
    assert one["notes"] == ["one\nlost  line"] and one["spouse_of"] == ["@F1@", "@F10@"]
    # pieces win over the whole name, MARRIED over the surname, and the married name's tag then finds another surname
    assert (two["first"], two["last"], two["maiden"], two["nickname"]) == ("Анна Anna Ивановна", "Сидорова", "Smith", "Аня")
    assert two["variants"] == ["Анна Anna Ивановна", "Попова", "Popova", "Аня", "Smith"] and two["living"] is True and two["birth_month"] == 3
    assert (two["residence_city"], two["residence_country"], two["residence_address"]) == ("Hamburg", "Germany", "Berlin")
    assert two["custom_tags"] == {"_UID": "a\nb", "RIN": "7", "ADDR": "me@x.org"} and (two["email"], two["website"], two["profile_id"]) == ("me@x.org", "x.org", "geni:12")
    assert two["photo_urls"] == ["http://x/1.jpg", "http://x/2.jpg"]
    assert (three["first"], three["last"], three["gender"]) == ("Petr", None, "Unknown")
    assert (five["first"], five["last"], five["suffix"], five["notes"], five["birth_year"], five["living"]) == (None, "Plain Name", "Jr", ["first half\nsecond"], None, None)


def test_families(tree):
    _, people = tree
    # the last family in file order that has a father, and the last that has a mother: @F10@ comes after @F9@
    assert (people["@I3@"]["father_id"], people["@I3@"]["mother_id"]) == ("@I5@", "@I2@")
    assert (people["@I4@"]["father_id"], people["@I4@"]["mother_id"], people["@I4@"]["sibling_ids"]) == ("@I5@", None, [])
    assert people["@I1@"]["spouse_ids"] == ["@I2@", "@I4@"] and people["@I1@"]["child_ids"] == ["@I3@", "@I5@"]
    assert people["@I4@"]["maiden"] == "Smirnova" and people["@I3@"]["spouse_ids"] == []


@pytest.mark.parametrize("wife, husband, same", [("Махина", "Махин", True), ("ИВАНОВА", "Иванов", True), ("Иванова", "Петров", False), ("Высоцкая", "Высоцкий", True), ("Smith", "Ivanov", False)])
def test_feminine(spark, wife, husband, same):
    assert spark.range(1).select(gedcom.feminine_of(F.lit(wife), F.lit(husband))).first()[0] is same


@pytest.mark.parametrize("text, want", [("3 MAY 1900", (1900, 5, 3, 2)), ("29 FEB 2001", (2001, 2, None, 1)), ("MAY 1900", (1900, 5, None, 1)), ("abt 1850", (1850, None, None, 0)), ("FROM 1 JAN 1900 TO 1901", (1900, 1, 1, 2)), ("INT 1900 (about)", (1900, None, None, 0)), ("4 XYZ 1900", (1900, None, None, 0)), ("spring", None), (None, None)])
def test_dates(spark, text, want):
    got = spark.range(1).select(gedcom.date(F.lit(text).cast("string")).alias("d")).first()["d"]
    assert (None if got is None else tuple(got)) == want


def test_many_splits_give_the_same_rows(spark, tmp_path):
    body = TEXT[TEXT.index("0 @I1@") : TEXT.index("0 TRLR")]
    whole = "0 HEAD\n" + "".join(body.replace("@ INDI", f"x{k}@ INDI").replace("@ FAM", f"x{k}@ FAM") for k in range(300)) + "0 TRLR\n"
    (tmp_path / "t.ged").write_text(whole.replace("\n", "\r\n"), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(whole.encode()) // 50))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = gedcom.read_records(spark, str(tmp_path / "t.ged"), "src")
        rows = records.orderBy("record").collect()
        splits = spark.read.option("lineSep", "\n0 ").text(str(tmp_path / "t.ged")).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert splits >= 40
    want = [gedcom.parse_record(x if x.startswith("0 ") else "0 " + x) for x in whole.split("\n0 ")]
    assert [(r["record"], r["id"], r["tag"], [tuple(x) for x in r["lines"]]) for r in rows] == [(i, *w) for i, w in enumerate(want)]


def test_utf16(spark, tmp_path):
    (tmp_path / "u.ged").write_bytes(TEXT.encode("utf-16"))
    rows = gedcom.read_records(spark, str(tmp_path / "u.ged"), "t").where("tag = 'INDI'").collect()
    assert len(rows) == 5 and any(x["value"] == "Попова\\Popova" for r in rows for x in r["lines"])

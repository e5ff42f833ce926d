"""Field differences, payloads, people already there, deliveries, surnames by marriage, and measures of the locale model."""

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinweave.functions import dates
from kinweave.operators import delivery, diff, existing, locale_model, marriage
from kinweave.scratch import Scratch

PERSON = "id string, first string, last string, maiden string, middle string, nickname string, suffix string, birth_date string, death_date string, burial_date string, birth_place string, death_place string, burial_place string, gender string, photos array<string>"
COLUMNS = [x.split(" ")[0] for x in PERSON.split(", ")]


def people(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], PERSON)


def pairs(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "src_id string, dst_id string")


def told(df):
    return {(r["src_id"], r["field"]): (r["src_value"], r["dst_value"], r["action"]) for r in df.collect()}


def test_differences_of_each_kind(spark):
    src = people(
        spark,
        {"id": "1", "first": " Ivan ", "last": "Petrov", "maiden": "SIDOROVA", "birth_date": "12 MAR 1850", "death_date": "1900", "burial_date": "no date", "gender": "Male", "photos": ["a", None, "b", "b"]},
        {"id": "2", "first": " \t", "maiden": "Orlova", "birth_date": "1850", "gender": None, "birth_place": "Kyiv"},
        {"id": "3"},
    )
    dst = people(
        spark,
        {"id": "1", "first": "  ", "last": "Sidorova", "birth_date": "ABT 1850", "death_date": "MAY 1900", "gender": "Unknown", "photos": ["a", "z"]},
        {"id": "2", "first": None, "last": "Petrova", "birth_date": "unreadable", "birth_place": "Lviv", "gender": "Female"},
        {"id": "3", "first": "Anna"},
    )
    mapping = pairs(spark, "1", "2", "3", "4")
    found = diff.differences(src, dst, mapping)
    assert told(found) == {
        ("1", "FirstName"): ("Ivan", None, "Add"), ("1", "BirthDate"): ("12 MAR 1850", "ABT 1850", "Update"), ("1", "Gender"): ("Male", None, "Add"), ("1", "PhotoUrl"): ("b", "a", "AddPhoto"),
        ("2", "MaidenName"): ("Orlova", None, "Add"), ("2", "BirthDate"): ("1850", None, "Add"),
    }
    assert {f for _, f in told(diff.differences(src, dst, mapping, ("PhotoUrl", "Gender")))} == {"FirstName", "BirthDate", "MaidenName"}
    assert [r["src_id"] for r in diff.identical(pairs(spark, "1", "2", "3"), found).collect()] == ["3"]
    assert [r["id"] for r in diff.usable(src).collect()] == ["1"]
    assert diff.differences(src.limit(0), dst, mapping).count() == 0


def test_photos_by_content(spark):
    rows = [("1", "1", "n", None, None), ("1", "1", "s", "d", 0.96), ("1", "1", "t", "e", 0.98), ("2", "2", "u", None, None)]
    matches = spark.createDataFrame(rows, "src_id string, dst_id string, src_url string, dst_url string, similarity double")
    found = diff.photo_differences(matches, spark.createDataFrame([("1", "first")], "dst_id string, url string"))
    assert sorted((r["src_value"], r["dst_value"], r["action"]) for r in found.collect()) == [("n", "first", "AddPhoto"), ("s", "d", "UpdatePhoto"), ("u", None, "AddPhoto")]


def test_payloads(spark):
    rows = [
        ("FirstName", "Ivan", "Add"), ("Gender", "Male", "Add"), ("BirthDate", "ABT 12 mar 1850", "Add"), ("BirthPlace", "Kyiv", "Add"), ("DeathDate", "unknown", "Add"), ("PhotoUrl", "p", "AddPhoto"), ("Suffix", "", "Add"), ("Odd", "x", "Add"),
    ]
    diffs = spark.createDataFrame([("1", "1", *r) for r in rows] + [("2", "2", "PhotoUrl", "p", "AddPhoto")], "src_id string, dst_id string, field string, src_value string, action string")
    (row,) = diff.service_payloads(diffs).collect()
    assert row["n_fields"] == 5
    assert json.loads(row["payload"]) == {"first_name": "Ivan", "gender": "male", "birth": {"date": {"day": 12, "month": 3, "year": 1850}, "location": {"place_name": "Kyiv"}}, "death": {}}
    (row,) = diff.service_payloads(diffs, ("BirthDate", "BirthPlace", "DeathDate")).collect()
    assert json.loads(row["payload"]) == {"first_name": "Ivan", "gender": "male"}
    made = {r["id"]: json.loads(r["payload"]) for r in diff.creation_payloads(people(spark, {"id": "1", "first": "Ivan", "gender": "F", "death_date": "7-JULY-1900", "death_place": " "}, {"id": "2", "gender": "Unknown"})).collect()}
    assert made == {"1": {"first_name": "Ivan", "gender": "female", "death": {"date": {"day": 7, "month": 7, "year": 1900}}, "is_alive": False}, "2": {"is_alive": True}}


@pytest.mark.parametrize(
    ("text", "update", "creation"),
    [
        ("14 JUL 1934", (14, 7, 1934), (14, 7, 1934)), ("1934", (None, None, 1934), (None, None, 1934)), ("bef  March 1934", (None, 3, 1934), (None, 3, 1934)),
        ("1934-07-14", (7, None, 1934), (14, None, 1934)), ("BET 1900 AND 1910", (None, None, 1900), (None, None, 1910)), ("JUL", None, (None, 7, None)), ("45 JUL 1934", (None, 7, 1934), (None, 7, 1934)), ("", None, None), (None, None, None),
    ],
)
def test_service_dates(spark, text, update, creation):
    row = spark.createDataFrame([(text,)], "t string").select(dates.update_form(F.col("t")).alias("u"), dates.creation_form(F.col("t")).alias("c")).first()
    assert (row["u"] and tuple(row["u"])) == update and (row["c"] and tuple(row["c"])) == creation


def test_existing_relatives(spark):
    additions = spark.createDataFrame([("a", "Ivan", "Petrov", "r"), ("b", " ivan", "Orlov", "r"), ("c", None, None, "r"), ("d", "Zoya", "Petrov", "r"), ("e", "Ivan", "Petrov", "gone")], "src_id string, first string, last string, dst_id string")
    families = spark.createDataFrame([("r", 2, "x"), ("r", 1, "y"), ("r", 3, "z")], "dst_id string, at int, member string")
    there = spark.createDataFrame([("x", "IVAN ", "Petrov", None), ("y", "Anna", "Orlova", "Petrov"), ("z", "Ivan", "Sidorov", "Orlov")], "id string, first string, last string, maiden string")
    found = existing.existing_relatives(additions, families, there)
    assert {r["src_id"]: (r["dst_id"], r["name"], r["via"]) for r in found.collect()} == {"a": ("x", "IVAN Petrov", "r"), "b": ("z", "Ivan Sidorov", "r"), "c": ("y", "Anna Orlova", "r")}
    assert sorted(r["src_id"] for r in existing.without_existing(additions, found).collect()) == ["d", "e"]


class Stop(BaseException):
    pass


def test_a_stopped_delivery_goes_on(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()

    def send(fail, row):
        if row["src_id"] == "3":
            raise delivery.Forbidden("403")
        if row["src_id"] in fail:
            raise OSError("busy")
        with open(box / f"{row['src_id']}-{row['digest'][:8]}", "a") as out:
            out.write("sent\n")

    nodes = spark.createDataFrame([(str(i), None if i == 4 else f"d{i}", f"p{i}") for i in range(30)] + [("0", "d0", "p0"), (None, "d", "p")], "src_id string, dst_id string, payload string")
    sink = delivery.Delivery(spark, str(tmp_path / "store"))
    # the first run stops after two of four batches
    written = []
    real = delivery._sending

    def stopping(f):
        written.append(1)
        if len(written) == 3:
            raise Stop
        return real(f)

    delivery._sending = stopping
    try:
        with pytest.raises(Stop):
            sink.run(nodes, lambda row: send(("7",), row), batches=4)
    finally:
        delivery._sending = real
    early = {p.name for p in box.iterdir()}
    assert 0 < len(early) < 28
    again = delivery.Delivery(spark, str(tmp_path / "store"))
    again.run(nodes, lambda row: send(("8",), row), batches=4)
    state = {r["src_id"]: (r["outcome"], r["reason"]) for r in again.state().collect()}
    assert len(state) == 30 and state["3"] == ("skipped", "403") and state["4"] == ("failed", "no profile") and state["8"] == ("failed", "busy")
    assert not again.finished()
    again.run(nodes.where("src_id <> '4'"), lambda row: send((), row), batches=4)
    assert all(p.read_text() == "sent\n" for p in box.iterdir()) and len(list(box.iterdir())) == 28
    assert [r["src_id"] for r in again.pending(nodes).collect()] == ["4"]
    # changed content is sent again, but not to who is forbidden
    changed = nodes.where("src_id in ('3', '5')").withColumn("payload", F.lit("new"))
    assert [r["src_id"] for r in again.pending(changed).collect()] == ["5"]
    again.clear()
    assert not (tmp_path / "store").exists()


def test_married_surnames(spark):
    schema = "id int, gender string, last string, maiden string, spouse_last string, names map<string,map<string,string>>, spouse_names map<string,string>"
    ru = lambda last, maiden=None: {"ru": {k: v for k, v in (("last_name", last), ("maiden_name", maiden), ("title", "t")) if v}}
    rows = [
        (1, "Male", "Petrov", None, "X", ru("Петров"), {}), (2, "Female", "Petrova", " ", None, {}, {}), (3, "Female", "Orlova", "Petrova", "Petrov", ru("Орлова", "Петрова"), {"ru": "Петров"}),
        (4, "Female", "Petrova", "Petrov", "Petrov", {}, {}), (5, "Female", "Orlova", "RYZHSKAYA", "Ryzhskiy", {}, {}), (6, "Female", "Orlova", "Ivanova", "Petrov", {}, {}), (7, "Unknown", "Orlova", None, None, {}, None), (8, None, None, None, None, None, None),
        (9, "Female", "Orlova", "Vaynskaya", "Vaynsky", {}, {}), (10, "Female", None, "Petrova", "Petrov", {}, {}), (11, "Female", "Орлова", "Горькая", "Горький", {}, {}),
    ]
    got = {r["id"]: r for r in marriage.married_surnames(spark.createDataFrame(rows, schema)).collect()}
    assert {i: (r["last"], r["maiden"]) for i, r in got.items()} == {
        1: ("Petrov", "Petrov"), 2: ("Petrova", "Petrova"), 3: ("Petrova", "Orlova"), 4: ("Petrova", "Petrov"), 5: ("RYZHSKAYA", "Orlova"), 6: ("Orlova", "Ivanova"), 7: ("Orlova", None), 8: (None, None),
        9: ("Vaynskaya", "Orlova"), 10: (None, "Petrova"), 11: ("Горькая", "Орлова"),
    }
    assert got[1]["names"] == {"ru": {"title": "t", "last_name": "Петров", "maiden_name": "Петров"}} and got[3]["names"]["ru"] == {"title": "t", "last_name": "Петрова", "maiden_name": "Орлова"}
    wives = marriage.spouse_surnames(spark.createDataFrame(rows, schema), spark.createDataFrame([(3, 6), (3, 1)], "id int, other int")).collect()
    assert [(r["id"], r["spouse_last"], r["spouse_names"]) for r in wives] == [(3, "Petrov", {"ru": "Петров"})]


def test_locale_model_measures_and_saving(spark, tmp_path):
    words = [(a + b, "first", "Male", lang) for lang, heads, tails in (("lt", "Jo Pet Kaz Ald", "nas ras ys is"), ("ru", "Ив Пет Сер Ал", "ан ов гей ин"), ("de", "Hein Lud Wolf Ger", "rich wig gang hard")) for a in heads.split() for b in tails.split()]
    rows = spark.createDataFrame(words, "name string, name_type string, gender string, locale string")
    model = locale_model.train(rows.coalesce(1), buckets=1 << 8)
    scored = locale_model.predict(model, rows).collect()
    (m,) = locale_model.metrics(locale_model.predict(model, rows)).collect()
    right = [r["predicted"] == r["locale"] for r in scored]
    each = [[x for x, r in zip(right, scored, strict=True) if r["locale"] == loc] for loc in ("lt", "ru", "de")]
    assert m["n"] == 48 and abs(m["micro_accuracy"] - sum(right) / 48) < 1e-12 and abs(m["macro_accuracy"] - sum(sum(x) / len(x) for x in each) / 3) < 1e-12
    assert abs(m["log_loss"] + sum(math.log(r["scores"][r["locale"]]) for r in scored) / 48) < 1e-9
    assert all(abs(sum(r["scores"].values()) - 1) < 1e-6 and r["confidence"] == max(r["scores"].values()) for r in scored)
    locale_model.save(model, str(tmp_path / "model"))
    again = locale_model.predict(locale_model.load(str(tmp_path / "model")), rows).collect()
    assert [r["scores"] for r in again] == [r["scores"] for r in scored]
    folds = locale_model.cross_validate(rows.coalesce(1), 2, buckets=1 << 8).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1] and sum(r["n"] for r in folds) == 48 and sum(r["micro_accuracy"] * r["n"] for r in folds) / 48 > 0.6


def test_locale_folds_train_on_all_cores(spark):
    words = [(a + b, "word", "unknown", lang) for lang, heads, tails in (("lt", "Jo Pet Kaz Ald", "nas ras ys is"), ("de", "Hein Lud Wolf Ger", "rich wig gang hard")) for a in heads.split() for b in tails.split()]
    rows = spark.createDataFrame([*words, ("Ив", "word", "unknown", "ru")], "name string, name_type string, gender string, locale string")
    scratch = Scratch(spark, "test-folds")
    found = {r["fold"]: r for r in locale_model.cross_validate(rows.coalesce(1), 2, scratch, buckets=1 << 8).collect()}
    (written,) = Path(scratch.root.removeprefix("file://")).iterdir()
    table = spark.read.parquet(f"file://{written}")
    assert table.count() == 33 and table.select(F.input_file_name()).distinct().count() > 4 and "grams" in table.columns
    # A fold without the only Russian word can't learn the locale.
    folds = locale_model.with_folds(rows, 2)
    (alone,) = [r["fold"] for r in folds.where("locale = 'ru'").collect()]
    for fold, m in found.items():
        model = locale_model.train(folds.where(F.col("fold") != fold).coalesce(1), buckets=1 << 8)
        (one,) = locale_model.metrics(locale_model.predict(model, folds.where(F.col("fold") == fold))).collect()
        assert all(abs(m[k] - one[k]) < 1e-6 for k in ("n", "micro_accuracy", "macro_accuracy", "log_loss"))
        # Only locales that are there are classes, so the first loss is the entropy of their shares.
        n = [r["count"] for r in folds.where(F.col("fold") != fold).groupBy("locale").count().collect()]
        assert model.stages[-1].numClasses == len(n) == (2 if fold == alone else 3)
        got, entropy = model.stages[-1].summary.objectiveHistory[0], -sum(x / sum(n) * math.log(x / sum(n)) for x in n)
        assert abs(got - entropy) < 0.02


def test_locale_model_of_one_locale(spark):
    rows = spark.createDataFrame([("Jonas", "first", "Male", "lt"), ("Petras", "first", "Male", "lt")], "name string, name_type string, gender string, locale string")
    (got,) = locale_model.predict(locale_model.train(rows.coalesce(1), buckets=1 << 8), rows.limit(1)).collect()
    assert got["predicted"] == "lt" and got["scores"] == {"lt": 1.0}

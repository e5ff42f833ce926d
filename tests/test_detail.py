"""The whole pair score, conflict resolution, and names by locale, against goldens and brute force."""

import random

from pyspark.sql import functions as F

from kinweave.functions import locales, similarity
from kinweave.operators import compare, localenames, resolve
from kinweave.scratch import Scratch

PERSON = "id string, first string, middle string, nickname string, last string, maiden string, gender string, birth_year int, birth_month int, birth_day int, birth_place string, father_id string, mother_id string, spouse_ids array<string>, child_ids array<string>"


def person(id, first=None, last=None, gender=None, born=(None, None, None), place=None, father=None, mother=None, middle=None, nickname=None, maiden=None, spouses=(), children=()):
    return (id, first, middle, nickname, last, maiden, gender, *born, place, father, mother, list(spouses), list(children))


def scores(spark, src, dst, weights=None):
    s, d = (compare.people(spark.createDataFrame(x, PERSON)) for x in (src, dst))
    pairs = spark.createDataFrame([(a[0], b[0]) for a in src for b in dst], "src_id string, dst_id string")
    return {(r["src_id"], r["dst_id"]): r for r in compare.scored(compare.fields(compare.paired(pairs, s, d)), weights).collect()}


def test_pair_score_goldens(spark):
    ivan = person("1", "Ivan", "Petrov", "Male", (1900, 5, 1), "Moscow")
    others = [
        person("1", "Ivan", "Petrov", "Male", (1900, 5, 1)), person("2", "Ivan", "Petrov", "Female", (1900, 5, 1)), person("3", "Иван", "Петров", "Male", (1900, 5, None), "Moscow, Russia"),
        person("4", "Ivan Vitalyevich", "Petrov", "Male"), person("5", None, None, None), person("6", "Иван", None, "Male", maiden="Petrov"), person("7", "Sergei", "Petrova", "Male", (1905, None, None)),
    ]
    got = {k[1]: round(r["score"], 2) for k, r in scores(spark, [ivan], others).items()}
    assert got["1"] == 71.26 and got["2"] == round(100 * 60 / 87, 2)
    assert got["3"] == round(100 * (25 + 20 + 15 * 0.95 + 10 * 0.8 + 2) / 97, 2)
    # a normalised name is one word: "ivanvitalyevich" contains "ivan"
    assert got["4"] == round(100 * (25 * max(0.85, similarity.jaro_winkler("ivan", "ivanvitalyevich")) + 20 + 2) / 72, 2)
    assert got["5"] == round(100 * 2 / 27, 2)
    assert got["6"] == round(100 * (25 + 20 + 2) / 72, 2)
    assert 0 < got["7"] < 60


def test_relatives_count_and_give_bonuses(spark):
    tree = [
        person("f", "Oleg", "Petrov", "Male"), person("m", "Anna", "Petrova", "Female"), person("w", "Maria", "Petrova", "Female"), person("c", "Boris", "Petrov", "Male"),
        person("1", "Ivan", "Petrov", "Male", father="f", mother="m", spouses=["w"], children=["c"]),
    ]
    other = [*tree[:3], person("c", "Zoya", "Petrova", "Female"), person("1", "Ivan", "Petrov", "Male", father="f", mother="m", spouses=["w"], children=["c"])]
    same, child = scores(spark, tree, tree)["1", "1"]["score"], scores(spark, tree, other)["1", "1"]["score"]
    assert same == 100.0
    family = (0.4 + 0.4 + 0.3) / 1.3
    assert abs(child - min(100, 100 * (25 + 20 + 2 + 25 * family) / 72 + 10)) < 1e-6
    assert compare.family_of([("father", "x", False, None, None)], [("father", "x", False, None, None)]) == (1.0, False, False)
    assert compare.kin_share("child", [("a", False, None, None)], [("a", False, None, None), ("b", False, None, None)]) == 0.5
    assert compare.family_of([], []) == (0.0, False, False)
    # first fit in order, each target once
    ann, anna = ("1", True, "ann", "x"), ("2", True, "anna", "x")
    assert compare.kin_share("sibling", [ann, anna], [anna]) == 0.5


def test_choice_equals_the_greedy_order(spark):
    rng = random.Random(5)
    rows = sorted({(rng.randrange(60), rng.randrange(50)) for _ in range(240)})
    rows = [(s, d, rng.choice([50, 60, 70, 80])) for s, d in rows]
    found = resolve.exclusive(spark.createDataFrame(rows, "src_id long, dst_id long, score int"))
    want, used, all_rows = {}, {7, 9}, found.collect()
    for r in sorted(all_rows, key=lambda r: (-r["exclusivity"], -r["score"], r["src_id"], r["dst_id"])):
        if r["src_id"] not in want and r["dst_id"] not in used:
            want[r["src_id"]] = (r["dst_id"], r["score"])
            used.add(r["dst_id"])
    taken = spark.createDataFrame([(7,), (9,)], "dst_id long")
    got = resolve.choose(found, taken, Scratch(spark, "t")).collect()
    assert {r["src_id"]: (r["dst_id"], r["score"]) for r in got} == want and len(got) == len(want)
    best = {s: max(x[2] for x in rows if x[0] == s) for s, _, _ in rows}
    for r in all_rows:
        every = sorted((x[2] for x in rows if x[0] == r["src_id"]), reverse=True)
        assert abs(r["exclusivity"] - (r["score"] - (every[1] if len(every) > 1 else 0)) / best[r["src_id"]]) < 1e-9


def profile(spark, names, **own):
    columns = {c: own.get(c) for c in ("first", "middle", "last", "maiden", "suffix")}
    return spark.createDataFrame([(1, names, *columns.values())], f"id long, names {localenames.MAP}, " + ", ".join(f"{c} string" for c in columns))


def test_names_by_locale(spark):
    got = localenames.fix(profile(spark, {"en-US": {"first_name": "Мария", "last_name": "Попова Popova"}, "en": {"first_name": " "}}, first="Мария", last="Müller")).first()
    assert got["names"]["ru"] == {"first_name": "Мария", "last_name": "Попова"}
    assert got["names"]["en-US"] == {"first_name": "Marija", "last_name": "Popova"} and "en" not in got["names"]
    assert (got["first"], got["last"]) == ("Marija", "Muller")
    he = localenames.fix(profile(spark, {"en-US": {"last_name": "Cohen כהן"}})).first()["names"]
    assert he["he"] == {"last_name": "כהן"} and he["en-US"] == {"last_name": "Cohen"}
    lt = localenames.fix(profile(spark, {"en-US": {"last_name": "Šimkus"}})).first()["names"]
    assert lt == {"lt": {"last_name": "Šimkus"}, "en-US": {"last_name": "Simkus"}}
    uk = localenames.fix(profile(spark, {"ru": {"last_name": "Шевченко"}})).first()["names"]
    assert uk["uk"] == uk["ru"] == {"last_name": "Шевченко"} and uk["en-US"] == {"last_name": "Shevchenko"}
    for empty in (None, {}):
        assert not localenames.fix(profile(spark, empty or {})).first()["names"]


def test_changes_name_their_stage(spark):
    rows = localenames.changes(profile(spark, {"en-US": {"first_name": "Иван"}}, first="Иван")).collect()
    seen = {(r["handler"], r["locale"], r["field"], r["old_value"], r["new_value"]) for r in rows}
    assert seen == {
        ("CyrillicToRu", "en-US", "first_name", "Иван", None), ("CyrillicToRu", "ru", "first_name", None, "Иван"),
        ("Translit", "en-US", "first_name", None, "Ivan"), ("Translit", None, "first_name", "Иван", "Ivan"),
    }


def test_locales(spark):
    rows = spark.createDataFrame([("ПЕТРОВА",), ("Kowalska",), ("Сковорода",), (None,)], "s string")
    assert [r[0] for r in rows.select(locales.surname_base(F.col("s"))).collect()] == ["ПЕТРОВ", "Kowalski", "Сковорода", ""]
    assert spark.range(1).select(locales.main_script(F.lit("Ивановский x")), locales.main_script(F.lit("abвг")), locales.script_locale(F.lit("Greek"))).first()[:] == ("Cyrillic", "Mixed", "el")

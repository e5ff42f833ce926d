"""Linkage functions and operators against values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import dates, names, similarity, variants
from kinweave.operators import blocking, compare, diff, family, graph, linkage, namefix, photos, wave


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (names.normalize, {"Иван-Петров": "ivanpetrov", "O'Connor": "oconnor", "  Marie ": "marie", " ": None}),
        (names.gedcom_id, {"I1": "@I1@", "@I1": "@I1@", "I1@": "@I1@", " I1 ": "@I1@", "F456": "@F456@", "": None}),
        (names.numeric_id, {"@I123@": "123", "geni:456": "456", "profile-789": "789", "invalid": None, "@Iabc@": None}),
        (names.profile_id, {"https://www.geni.com/api/profile-g34828568625": "34828568625", "PROFILE-G34828568625": "34828568625", "G34828568625": "34828568625", None: ""}),
        (names.script, {"Привет Hello": "Mixed", "שלום": "Hebrew", "123 !@#": "Unknown", "Иван": "Cyrillic", "Müller": "Latin"}),
        (names.latin_language, {"Jonaitis": "lt", "Kazlauskaitė": "lt", "Mägi": "et", "Tammsaar": "et", "Wójcik": "pl", "Kowalski": "en", "Müller": "de", "Schmidt": "en"}),
        (names.remove_diacritics, {"Weiß": "Weiss", "Żółty": "Zolty", "Ķēniņš": "Kenins", "Søren": "Soren", "Æther": "AEther"}),
        (names.feminine, {"Чайковский": "Чайковская", "Popov": "Popova", "Шевченко": "Шевченко"}),
        (names.capitalize, {"JOHN SMITH": "John Smith", "anna-maria": "Anna-Maria", "o'brien": "O'Brien", "McDonald": "McDonald"}),
        (names.clean_special, {"*12 [Bob]  Ray?": "Bob Ray", "#Ann": "Ann"}),
        (names.photo_source, {"https://media.geni.com/a.jpg?hash=1": "geni", "https://www.myheritage.com/x": "myheritage", "https://notgeni.com/x": "other", "bad url": "other"}),
    ],
)
def test_name_functions(spark, function, cases):
    assert apply(spark, function, list(cases)) == list(cases.values())


def test_dates(spark):
    cases = {"15 JAN 1990": ("1990-01-15", None), "JAN 1990": ("1990-01", None), "1990": ("1990", None), "BET 1900 AND 1910": ("1900", "BET"), "31 FEB 2000": ("2000-02", None), "ABT 1850": ("1850", "ABT")}
    rows = spark.createDataFrame([(v,) for v in cases], "v string").withColumn("p", dates.parse(F.col("v")))
    assert {r["v"]: (r["f"], r["modifier"]) for r in rows.select("v", dates.form(F.col("p")).alias("f"), "p.modifier").collect()} == cases
    assert apply(spark, lambda c: dates.parse(c).isNull(), ["none", None]) == [True, True]


def test_similarity():
    assert round(similarity.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(similarity.jaro_winkler("vladimir", "vladimira"), 4) == 0.9926
    assert similarity.jaro_winkler("", "a") == 0.0 and similarity.jaro_winkler("a", "a") == 1.0 and similarity.jaro_winkler(None, "a") is None


def test_variants_are_stars(spark):
    edges = set(variants.edges())
    assert ("иван", "john") in edges and ("john", "иван") in edges and ("ivan", "john") not in edges


def test_variants_from_csv(spark, tmp_path):
    (tmp_path / "v.csv").write_text('name,similar_names\nБорис,"boris borya"\n')
    got = {(r["a"], r["b"]) for r in variants.load_csv(spark, str(tmp_path / "v.csv")).collect()}
    assert {("борис", "boris"), ("boris", "борис"), ("борис", "borya")} <= got


PEOPLE = [(0, "Male", 1900, None, None), (1, "Female", 1902, None, None), (2, "Male", 1925, 0, 1), (3, "Female", 1927, 0, 1), (4, "Male", 1930, 0, None), (5, "Female", 1926, None, None), (6, "Male", 1950, 2, 5)]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "id long, gender string, birth_year int, father_id long, mother_id long")


def test_graph(spark, people):
    assert {(r["id"], r["other"]) for r in graph.siblings(people).collect()} == {(2, 3), (3, 2)}
    assert {(r["id"], r["other"]) for r in graph.siblings(people, "any").collect()} == {(a, b) for a in (2, 3, 4) for b in (2, 3, 4) if a != b}
    assert {r["id"]: r["depth"] for r in graph.bfs(people, 6, 2).collect()} == {6: 0, 2: 1, 5: 1, 0: 2, 1: 2, 3: 2}
    assert (6, 0) in {(r["id"], r["other"]) for r in graph.within_two(people).collect()}


def test_structure_score(spark, people):
    f = family.families(people)
    mapping = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "src_id long, dst_id long")
    rows = {(r["sh"], r["sw"], r["dh"], r["dw"]): r["structure"] for r in family.structure_scores(f, f, mapping).collect()}
    assert rows[(0, 1, 0, 1)] == 120 and rows[(2, 5, 2, 5)] == 60 and (0, 1, 0, None) not in rows


def test_assignment_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 90.0), (1, 1, 2, 95.0), (1, 2, 2, 94.0), (1, 2, 1, 50.0)], "family long, src_id long, dst_id long, score double")
    assert {(r["src_id"], r["dst_id"]) for r in family.assign(pairs).collect()} == {(1, 2), (2, 1)}


def test_wave_maps_equal_trees(spark, people):
    scores = spark.createDataFrame([(i, i, 70.0) for i in range(7)], "src_id long, dst_id long, score double")
    got = {r["src_id"]: (r["dst_id"], r["level"]) for r in wave.align(people, people, scores, spark.createDataFrame([(0, 0)], "src_id long, dst_id long")).collect()}
    # the family of person 4 has one parent, and the two-parent family that it ties with comes first
    assert {k: v[0] for k, v in got.items()} == {i: i for i in range(7) if i != 4} and got[0][1] == 0 and got[1][1] == 1 and got[6][1] == 2


def test_diff_and_payload(spark):
    one, two = ([(1, "A", None)], "id long, first string, place string"), ([(1, None, None)], "id long, first string, place string")
    mapping = spark.createDataFrame([(1, 1)], "src_id long, dst_id long")
    rows = diff.added_fields(spark.createDataFrame(*one), spark.createDataFrame(*two), mapping, ["first", "place"])
    assert [(r["field"], r["new_value"], r["action"]) for r in rows.collect()] == [("first", "A", "Add")]
    assert diff.update_payload(rows).first()["payload"] == '{"first":"A"}'


def test_name_fix(spark):
    rows = spark.createDataFrame(
        [(1, "Male", "Dr. John", "Smith Jr."), (2, "Female", "АННА", "Попов (урожд. Иванов)"), (3, "Male", "Robert (Bob)", "VON NEUMANN"), (4, "Male", "Иван Петрович", "Сидоров"), (5, "Unknown", None, "")],
        "id long, gender string, first string, last string",
    )
    got = {r["id"]: r for r in namefix.fix(namefix.profiles(rows)).collect()}
    assert (got[1]["title"], got[1]["first"], got[1]["last"], got[1]["suffix"], got[1]["maiden"]) == ("Dr.", "John", "Smith", "Jr", "Smith")
    assert (got[2]["first"], got[2]["last"], got[2]["maiden"]) == ("Анна", "Попова", "Иванова")
    assert (got[3]["first"], got[3]["nickname"], got[3]["last"]) == ("Robert", "Bob", "von Neumann")
    assert (got[4]["first"], got[4]["middle"], got[4]["last"]) == ("Иван", "Петрович", "Сидоров")
    assert (got[5]["first"], got[5]["last"]) == (None, None)
    changed = {(r["id"], r["field"]): (r["old_value"], r["new_value"]) for r in namefix.changes(namefix.profiles(rows)).collect()}
    assert changed[(4, "middle")] == (None, "Петрович") and changed[(3, "last")] == ("VON NEUMANN", "von Neumann")


def test_split_by_script(spark):
    rows = spark.createDataFrame([("Анна-Anna (חנה)",)], "v string").select(names.split_by_script(F.col("v")).alias("s")).first()["s"]
    assert tuple(rows) == ("Анна", "Anna", "חנה")


def test_photo_matching(spark):
    rows = [(1, "src", 0, "a", "h1", 0), (1, "src", 1, "b", None, 1), (1, "src", 2, "c", None, -1), (1, "dst", 0, "x", None, 0), (1, "dst", 1, "y", "h1", 99)]
    frame = spark.createDataFrame(rows, "pair long, side string, pos int, url string, content_hash string, perceptual_hash long")
    got = {r["src_url"]: (r["dst_url"], r["similarity"]) for r in photos.match(frame).collect()}
    assert got == {"a": ("y", 1.0), "b": ("x", 0.984375), "c": (None, None)}


SCHEMA = "id long, first string, last string, maiden string, gender string, birth_year int"
LADDER = [
    (1, "Anna", "Petrova", None, "Female", 1900), (2, "Anna", "Petrov", None, "Female", 1900), (3, "Anna", "Smith", "Petrova", "Female", 1901), (4, "Anna", None, "Petrova", "Female", 1900),
    (5, "Anna", None, None, "Female", 1900), (6, "Ivan", "Чайковский", None, "Male", 1905), (7, "Ann", "Kowalska", "Smith", "Unknown", 1912), (8, None, "-", "Smith", "Female", 1909),
]
TO = [(1, "Anna", "Petrova", None, "Female", 1900), (2, "Иван", "Chaikovskiy", None, "Male", 1905), (3, "Hanna", "Smit", "Kovalska", "Female", 1910)]


def whole(spark, rows):
    return compare.people(spark.createDataFrame(rows, SCHEMA))


def test_surnames_are_scored(spark):
    src, dst = whole(spark, LADDER), whole(spark, TO)
    pairs = blocking.all_pairs(src, dst)
    sims = {(int(r["s_id"]), int(r["d_id"])): r["last_sim"] for r in compare.own_fields(compare.paired(pairs, src.drop("kin"), dst.drop("kin"))).collect()}
    got = [sims[k] for k in [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2)]]
    assert got[0] == 1.0 and got[2:5] == [0.95, 1.0, None]
    assert got[1] == similarity.jaro_winkler("petrov", "petrova") and got[5] == similarity.jaro_winkler("chaykovskiy", "chaikovskiy") and sims[4, 3] == 0.3
    # the surname that differs in a letter is found through the given name
    best = {r["src_id"]: r["dst_id"] for r in linkage.best_matches(spark.createDataFrame(LADDER, SCHEMA), spark.createDataFrame(TO, SCHEMA), 50).collect()}
    assert best[6] == 2 and best[2] == 1


def test_python_score_is_the_score_of_columns(spark):
    rng = random.Random(3)
    names_ = ["Ivan", "Иван", "John", "Maria", "Мария", "Marina", "Anna-Maria", "Ann", None, "-"]
    lasts = ["Petrov", "Petrova", "Петров", "Chaikovskiy", "Чайковский", None, "Smith"]
    places = ["Moscow", "Moscow, Russia", "Kiev Ukraine", "kiev-ukraine", None, "St. Petersburg"]
    rows = []
    for i in range(60):
        day = rng.choice([(None, None, None), (1900, None, None), (1901, 5, None), (1900, 5, 7), (1900, 6, 7), (1909, 5, 8)])
        rows.append((i, rng.choice(names_), rng.choice(names_), rng.choice(names_), rng.choice(lasts), rng.choice(lasts), rng.choice(["Male", "Female", None]), *day, rng.choice([None, 1950, 1951]), rng.choice(places), *(rng.choice([None, rng.randrange(60)]) for _ in "fm"), rng.sample(range(70), rng.choice([0, 1])), rng.sample(range(70), rng.choice([0, 0, 2])), [rng.choice([x for x in names_ if x])]))
    schema = "id long, first string, middle string, nickname string, last string, maiden string, gender string, birth_year int, birth_month int, birth_day int, death_year int, birth_place string, father_id long, mother_id long, spouse_ids array<long>, child_ids array<long>, variants array<string>"
    people = compare.people(spark.createDataFrame(rows, schema))
    held = {r["id"]: r.asDict() for r in people.collect()}
    pairs = spark.createDataFrame([(str(a), str(b)) for a in range(60) for b in range(0, 60, 3)], "src_id string, dst_id string")
    got = {(r["src_id"], r["dst_id"]): r["score"] for r in compare.scored(compare.fields(compare.paired(pairs, people, people))).collect()}
    score = compare.Scorer()
    assert len(got) == 1200 and len({round(x, 3) for x in got.values()}) > 300
    assert all(x == pytest.approx(score(held[a], held[b])) for (a, b), x in got.items())


def test_blocked_pairs_are_pairs_that_fit_each_once(spark):
    src, dst = whole(spark, LADDER), whole(spark, [*TO, (4, "Ivan", "Иванов", None, None, None), (5, "Hans", "Chaikovskij", None, "Male", 1800)])
    every = {(r["src_id"], r["dst_id"]) for r in blocking.all_pairs(src, dst).collect()}
    rows = [(r["src_id"], r["dst_id"]) for r in blocking.candidates(src, dst).collect()]
    assert len(rows) == len(set(rows)) and set(rows) < every and {("6", "2"), ("1", "1"), ("4", "1"), ("6", "4")} <= set(rows)
    wanted = linkage.scored_pairs(spark.createDataFrame(LADDER, SCHEMA), spark.createDataFrame(TO, SCHEMA), blocking.all_pairs(src, whole(spark, TO)), 60)
    assert blocking.recall(blocking.candidates(src, dst), wanted.withColumns({c: F.col(c).cast("string") for c in ("src_id", "dst_id")})) == 1.0
    # saved indexes meet without a shuffle, in the same pairs
    a, b = blocking.save(src, "kin_src", 4), blocking.save(dst, "kin_dst", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = blocking.pairs(a, b)
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert {(r["src_id"], r["dst_id"]) for r in met.collect()} == set(rows) and met.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE kin_src")
        spark.sql("DROP TABLE kin_dst")


@pytest.mark.parametrize("part", [512, 4])
def test_top_matches(spark, monkeypatch, part):
    monkeypatch.setattr(linkage, "PART", part)
    rng = random.Random(4)
    rows = sorted({(rng.randrange(5) if rng.random() < 0.3 else 9, rng.randrange(300)) for _ in range(500)})
    rows = [(s, d, float(rng.randrange(40))) for s, d in rows]
    got = {(r["src_id"], r["rank"]): (r["dst_id"], r["score"]) for r in linkage.top_matches(spark.createDataFrame(rows, "src_id long, dst_id long, score double"), 3).collect()}
    want = {}
    for s in {x[0] for x in rows}:
        for k, (_, d, x) in enumerate(sorted((-x, d, x) for t, d, x in rows if t == s)[:3]):
            want[s, k + 1] = (d, x)
    assert got == want


def test_walk_scores_families_whatever_the_surname(spark, people):
    named = people.withColumns({"first": F.concat(F.lit("Name"), F.col("id").cast("string")), "last": F.lit("Чайковский")})
    got = {r["src_id"]: r["dst_id"] for r in wave.align(named, named.withColumn("last", F.lit("Chaikovskiy")), None, spark.createDataFrame([(0, 0)], "src_id long, dst_id long")).collect()}
    assert got == {i: i for i in range(7) if i != 4}


def test_people_without_year_surname_or_gender_are_compared(spark):
    src = spark.createDataFrame([(1, "Anna", "Petrova", None, "Female", None), (2, "Ivan", None, None, "Male", 1900), (3, "Olga", "Orlova", None, None, 1950)], SCHEMA)
    dst = spark.createDataFrame([(1, "Anna", "Petrova", None, None, 1900), (2, "Ivan", "Petrov", None, "Male", None), (3, "Olga", "Orlova", None, "Female", 1951), (4, "Anna", "Petrova", None, "Female", 1990)], SCHEMA)
    pairs = blocking.all_pairs(compare.people(src), compare.people(dst))
    got = {(r["src_id"], r["dst_id"]): r["score"] for r in linkage.scored_pairs(src, dst, pairs).collect()}
    # person 1 has no year and meets all but the man, a null gender meets both
    assert set(got) == {(1, 1), (1, 3), (1, 4), (2, 1), (2, 2), (3, 2), (3, 3)}
    # null fields are left out, an unknown gender has its points: first, last and gender of 72; first and gender of 52; first, last, birth and gender of 87
    assert got[1, 1] == pytest.approx(100 * 47 / 72) and got[2, 2] == pytest.approx(100 * 27 / 52) and got[3, 3] == pytest.approx(100 * (45 + 12 + 2) / 87)
    assert {r["src_id"]: r["dst_id"] for r in linkage.best_matches(src, dst, 50).collect()} == {1: 1, 2: 2, 3: 3}


def test_many_walks_side_by_side(spark, people):
    named = people.withColumns({"first": F.concat(F.lit("Name"), F.col("id").cast("string")), "last": F.lit("Petrov")})
    many = named.crossJoin(spark.range(3).withColumnRenamed("id", "walk"))
    apart = many.withColumns({c: F.col(c) + 100 * F.col("walk") for c in ("id", "father_id", "mother_id")})
    anchors = spark.range(3).select(F.col("id").alias("walk"), (100 * F.col("id")).alias("src_id"), (100 * F.col("id")).alias("dst_id"))
    rows = wave.align(apart, apart, None, anchors).collect()
    assert {(r["walk"], r["src_id"]) for r in rows} == {(w, 100 * w + i) for w in range(3) for i in range(7) if i != 4} and all(r["src_id"] == r["dst_id"] for r in rows)


def test_date_and_gender_goldens(spark):
    """Values of the rules, not of our formula: years alone 0.90, other months 0.85; an unknown gender has full points."""
    cases = [((1900, None, None), (1900, None, None), 0.90), ((1900, None, None), (1900, 5, 1), 0.90), ((1900, 4, 1), (1900, 5, 1), 0.85), ((1900, 5, None), (1900, 5, 3), 0.95), ((1900, 5, 2), (1900, 5, 3), 0.95), ((1900, 5, 3), (1900, 5, 3), 1.0), ((1900, 5, 3), (1901, 5, 3), 0.80), ((1900, 1, 1), (1902, 1, 1), 0.60), ((1900, 1, 1), (1905, 1, 1), 0.40), ((1900, 1, 1), (1910, 1, 1), 0.20), ((1900, 1, 1), (1911, 1, 1), 0.0)]
    rows = spark.createDataFrame([(i, *(v for x in (a, b) for v in x)) for i, (a, b, _) in enumerate(cases)], "i int, s_birth_year int, s_birth_month int, s_birth_day int, d_birth_year int, d_birth_month int, d_birth_day int")
    assert {r["i"]: r["x"] for r in rows.select("i", compare.event("birth").alias("x")).collect()} == {i: c[2] for i, c in enumerate(cases)}
    two = lambda g: compare.people(spark.createDataFrame([(1, "Ivan", "Petrov", None, g, None)], SCHEMA))
    pair = spark.createDataFrame([("1", "1")], "src_id string, dst_id string")
    points = lambda a, b: compare.scored(compare.fields(compare.paired(pair, two(a), two(b)))).first()["score"]
    assert points("Unknown", "Male") == points("Male", "Male") == points(None, "Female") == pytest.approx(100 * 47 / 72) and points("Female", "Male") == pytest.approx(100 * 45 / 72)

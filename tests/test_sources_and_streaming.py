"""JSON sources and incremental linkage."""

import json

from kinweave.sources import profiles
from kinweave.streaming import incremental


def test_profiles_wrapped_or_bare(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"id": "p1", "first_name": "Anna", "names": {"ru": {"first_name": "Анна", "last_name": " "}}, "birth": {"date": {"year": 1900}}}, {"id": "p2"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"id": "p3", "gender": "male"}))
    rows = {r["id"]: r for r in profiles.read_profiles(spark, str(tmp_path)).collect()}
    assert set(rows) == {"p1", "p2", "p3"} and rows["p1"]["birth"]["date"]["year"] == 1900 and rows["p3"]["gender"] == "male"
    assert [tuple(r) for r in profiles.localised(profiles.read_profiles(spark, str(tmp_path))).collect()] == [("p1", "ru", "first_name", "Анна")]


def test_unions(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"results": [{"id": "u1", "partners": ["https://x/api/p1", "https://x/api/p2"], "children": ["https://x/api/p3"]}]}))
    assert {tuple(r) for r in profiles.parent_links(profiles.read_unions(spark, str(tmp_path / "u.json"))).collect()} == {("p3", "p1"), ("p3", "p2")}


def test_incremental_linkage(spark, tmp_path):
    schema = "id long, first string, last string, gender string, birth_year int"
    target = spark.createDataFrame([(1, "Ivan", "Petrov", "Male", 1900), (2, "Anna", "Petrova", "Female", 1902)], schema)
    spark.createDataFrame([(10, "Иван", "Петров", "Male", 1901), (10, "Иван", "Петров", "Male", 1901), (11, "Zoe", "Unknown", "Female", 1900)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    incremental.link_stream(stream, target, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert [(r["src_id"], r["dst_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(10, 1)]

"""Fields of pairs whose given names are compared once for each distinct pair."""

from pyspark.sql import functions as F

from kinweave.operators import compare
from kinweave.plans import detail, registry
from kinweave.scratch import Scratch

SCHEMA = "id long, first string, middle string, last string, maiden string, gender string, birth_year int, father_id long, mother_id long"
ROWS = [(1, "Ivan", None, "Petrov", None, "Male", 1900, None, None), (2, "Anna", "Maria", "Petrova", "Orlova", "Female", 1902, None, None), (3, "John", None, "Petrov", None, "Male", 1925, 1, 2), (4, None, "Johann", None, "Orlova", None, None, 1, 9)]


def test_fields_of_names_compared_once_are_those_of_each_pair(spark):
    a = spark.createDataFrame(ROWS, SCHEMA)
    b = a.withColumn("first", F.when(F.col("id") == 3, "Иван").otherwise(F.col("first")))
    pairs = a.select(F.col("id").alias("src_id")).crossJoin(b.select(F.col("id").alias("dst_id")))
    scratch = Scratch(spark, "test-fields")
    left, right = (scratch.keep(compare.nameless(x), "people") for x in (a, b))
    assert not set(compare.TOKENS[:4]) & set(left.columns)
    rows = lambda df: {(r["src_id"], r["dst_id"]): (round(r["score"], 9), tuple((x["field"], round(x["points"], 9)) for x in r["reasons"])) for r in compare.scored(df).collect()}
    got = rows(compare.fields_of(pairs, left, right, scratch))
    assert len(got) == 16 and got == rows(compare.fields(compare.paired(pairs, compare.people(a), compare.people(b))))


def test_resolved_mappings_make_the_fixture_once(spark, tmp_path):
    """The mapping, its targets and their relatives come from one written tree, not from the customers wherever they are read."""
    spark.range(70).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    found = detail.queries()["resolved_mappings"](spark, str(tmp_path))
    assert found.count() > 40 and not [x for x in found.inputFiles() if "customer" in x]


def test_child_assignment_reads_customers_for_two_trees_alone(spark, tmp_path, monkeypatch):
    spark.range(70).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": kept.append((name, any("customer" in x for x in df.inputFiles()))) or keep(self, df, name))
    assert registry.queries()["child_assignment"](spark, str(tmp_path)).count() > 40
    assert [name for name, read in kept if read] == ["tree", "tree"]

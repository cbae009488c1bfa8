"""Replacement in place: what is replaced, what stays, and what a failure leaves."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import registry as g
from corpusloom.sources import sinks, tables

KIND = "court string, id int, text string"


def rows(spark, path):
    return {tuple(r) for r in spark.read.schema(KIND).parquet(path).select("court", "id", "text").collect()}


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.fixture
def held(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_in_place(spark.createDataFrame([("01", 1, "a"), ("01", 2, "b"), ("b", 1, "c"), (None, 7, "d")], KIND), path, ["court", "id"], ["court"])
    return path


def test_only_its_keys_and_partitions(spark, held):
    before = files(held)
    sinks.replace_in_place(spark.createDataFrame([("01", 2, "B"), ("01", 3, None), (None, 7, "D"), ("new", 1, "x")], KIND), held, ["court", "id"], ["court"])
    assert rows(spark, held) == {("01", 1, "a"), ("01", 2, "B"), ("01", 3, None), ("b", 1, "c"), (None, 7, "D"), ("new", 1, "x")}
    assert {f for f in before if "court=b" in f} <= files(held)
    assert not {f for f in before if "court=01" in f} & files(held)


def test_a_failure_half_way_leaves_the_old_rows(spark, held):
    before = files(held)
    new = spark.range(1, 200, 1, 8).select(F.when(F.col("id") % 2 == 0, "01").otherwise("b").alias("court"), F.col("id").cast("int").alias("id"), F.when(F.col("id") == 150, F.raise_error(F.lit("half-way"))).otherwise(F.lit("z")).alias("text"))
    with pytest.raises(Exception, match="half-way"):
        sinks.replace_in_place(new, held, ["court", "id"], ["court"])
    assert files(held) == before and len(rows(spark, held)) == 4


def test_nothing_new_and_keys_without_partitions(spark, held):
    none = spark.createDataFrame([], KIND)
    sinks.replace_in_place(none, held, ["court", "id"], ["court"])
    assert len(rows(spark, held)) == 4
    with pytest.raises(ValueError):
        sinks.replace_in_place(none, held, ["id"], ["court"])


def test_registry_by_lines(spark, tmp_path):
    entries = spark.createDataFrame([("Anna Bell", ["A. Bell", "Bell"]), ("Bell", None), ("Zoe", [])], "canonical string, aliases array<string>")
    path = str(tmp_path / "r")
    g.write_registry(entries.repartition(3), path)
    assert {r["key"]: r["canonical"] for r in tables.registry(spark, path, lines=True).collect()} == {"anna bell": "Anna Bell", "a. bell": "Anna Bell", "bell": "Bell", "zoe": "Zoe"}

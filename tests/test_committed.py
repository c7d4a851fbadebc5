import os

import pytest

from filingforge.sources import committed
from filingforge.sources.files import read_folder_long

SCHEMA = "k string, n int, v string"


def rows_of(spark, path):
    return sorted((tuple(r) for r in committed.read_committed(spark, path).collect()), key=repr)


def test_partitions_are_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path)
    first = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z"), ("1", 4, "w")], SCHEMA)
    committed.write_table_again(first, path, ["k"])
    assert rows_of(spark, path) == sorted(map(tuple, first.collect()), key=repr)
    again = spark.createDataFrame([("b", 5, "new"), (None, 6, "new")], SCHEMA)
    for _ in range(3):
        committed.write_table_again(again, path, ["k"])
    want = sorted([("a", 1, "x"), ("1", 4, "w"), ("b", 5, "new"), (None, 6, "new")], key=repr)
    assert rows_of(spark, path) == want
    committed.write_version(first, path, ["k"])  # killed before its commit
    committed.write_table_again(first.limit(0), path, ["k"])
    assert rows_of(spark, path) == want


def test_whole_tables_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.write_table_again(spark.createDataFrame([("a", 1, "x")], SCHEMA), path)
    committed.write_table_again(spark.createDataFrame([("b", 2, "y")], SCHEMA), path)
    assert rows_of(spark, path) == [("b", 2, "y")]


def test_files_are_sized_whatever_the_key(spark, tmp_path):
    """A hot partition gets several files, small ones a single file each, though they come from many tasks."""
    path = str(tmp_path / "t")
    rows = spark.range(400_000, numPartitions=16).selectExpr("if(id % 10 < 8, 'hot', concat('k', id % 10)) AS k", "cast(id as int) AS n", "sha2(cast(id as string), 256) AS v")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        version = committed.write_version(rows, path, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = {d: len([f for f in os.listdir(f"{path}/data/version={version}/{d}") if f.endswith(".parquet")]) for d in ("k=hot", "k=k8", "k=k9")}
    assert files["k=hot"] >= 3 and files["k=k8"] <= 2 and files["k=k9"] <= 2


def test_growing_folder_equals_one_pass(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "in" / "out")
    source.mkdir()

    def added():
        committed.add_new_files(spark, str(source), target)
        return sorted((tuple(r) for r in committed.read_added(spark, target).collect()), key=repr)

    def whole():
        return sorted((tuple(r) for r in read_folder_long(spark, f"{source}/*.csv").collect()), key=repr)

    (source / "a b.csv").write_text("x,y\n1,2\n")
    (source / "empty.csv").write_text("")
    assert added() == whole() and len(added()) == 2
    (source / "c+d%.csv").write_text('y,z\n5,"two\nlines"\n')
    (source / "same.csv").write_text("x,y\n1,2\n")  # the same contents under another name
    assert added() == whole() and len(added()) == 6
    os.utime(source / "a b.csv", (1, 1))  # touched only
    versions = len(os.listdir(f"{target}/data"))
    assert added() == whole()
    (source / "same.csv").write_text("x\n9\n7\n")
    assert added() == whole() and ("same.csv", 1, "x", "9") in added()
    assert len(os.listdir(f"{target}/data")) == versions + 2

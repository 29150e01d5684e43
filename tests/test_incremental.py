"""Scans of new files only."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources.incremental import list_files, newest_product, scan_new
from tidemark.sources.tables import MissingSource


def put(folder, name, text, at):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (at, at))


def test_a_second_scan_reads_only_new_files(spark, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "taken")
    asked = []

    def read(paths):
        asked.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        return spark.read.text(paths)

    def scan(batch):
        return scan_new(spark, folder, log, batch, read, "*.txt")

    put(folder, "a.txt", "1\n2\n", 1000)
    put(folder, "b.txt", "3\n", 1000)
    put(folder, "c.log", "no\n", 1000)
    first = scan("one")
    assert sorted(r[0] for r in first.rows.collect()) == ["1", "2", "3"]
    again = scan("one")
    assert asked == [["a.txt", "b.txt"]] * 2  # not marked: found again
    again.mark()
    again.mark()
    assert scan("two").rows is None and spark.read.parquet(log).count() == 2
    put(folder, "d.txt", "4\n", 2000)
    put(folder, "a.txt", "1\n2\n5\n", 2000)
    changed = scan("two")
    assert asked[-1] == ["a.txt", "d.txt"] and changed.rows.count() == 4
    changed.mark()
    assert scan("three").rows is None


def test_newest_product_from_the_listing(spark, tmp_path):
    folder = str(tmp_path)
    put(f"{folder}/feature_matrix_a_csv", "part-0.csv", "x\n", 1000)
    put(f"{folder}/feature_matrix_b_csv", "part-0.csv", "x\n", 3000)
    put(f"{folder}/feature_matrix_c_csv", "part-0.csv", "x\n", 3000)
    put(f"{folder}/other", "part-0.csv", "x\n", 9000)
    assert newest_product(spark, folder) == "feature_matrix_c_csv"
    assert list_files(spark, folder).agg(F.sum("size")).first()[0] == 8
    with pytest.raises(MissingSource):
        newest_product(spark, f"{folder}/other")

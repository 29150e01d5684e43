"""Scans that read each file once: a table of the files already taken, and an anti join against it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.session import materialise
from tidemark.sources.runlog import upsert_runs
from tidemark.sources.tables import MissingSource, _exists

FILES = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("modified", T.TimestampType()), T.StructField("size", T.LongType()),
])


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(file_path, modified, size) of all files below a folder; no file is opened."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return found.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def taken_files(spark: SparkSession, log: str) -> DataFrame:
    """Files that earlier scans have taken; none if there was no scan."""
    if not _exists(spark, log):
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(log)


def unseen(files: DataFrame, taken: DataFrame) -> DataFrame:
    """Files not taken yet, or changed since: another time or another size."""
    same = [files[c].eqNullSafe(taken[c]) for c in FILES.names]
    return files.join(taken, same, "left_anti")


@dataclass(frozen=True)
class NewFiles:
    """Files that a scan found, the rows in them, and what marks them as taken."""

    files: DataFrame
    rows: DataFrame | None
    log: str
    batch: str

    def mark(self) -> None:
        """Remember the files, once their rows are safely used; marking a batch again changes nothing."""
        if self.rows is not None:
            upsert_runs(self.files.withColumn("batch", F.lit(self.batch)), self.log, "batch")


def scan_new(
    spark: SparkSession, folder: str, log: str, batch: str, read: Callable[[list[str]], DataFrame], pattern: str = "*"
) -> NewFiles:
    """Rows of the files below ``folder`` that no marked batch has taken; ``rows`` is None if there are none.

    ``read`` makes a table from paths and runs on the new ones only. A scan that is not marked, because it or what used
    it broke off, is found again. What reaches the driver is the list of new paths, as for any scan.
    """
    files = materialise(unseen(list_files(spark, folder, pattern), taken_files(spark, log)))
    paths = [row["file_path"] for row in files.select("file_path").collect()]
    return NewFiles(files, read(paths) if paths else None, log, batch)


def newest_of(files: DataFrame, product: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """(product, modified): the folders that hold files, by their newest file, from the listing alone."""
    folder = F.regexp_extract("file_path", product, 1)
    return files.groupBy(folder.alias("product")).agg(F.max("modified").alias("modified"))


def newest_product(spark: SparkSession, folder: str, pattern: str = "*.csv", product: str = r"([^/]+_csv)/[^/]+$") -> str:
    """Name of the product below ``folder`` that was written last; equal times are decided by name."""
    found = newest_of(list_files(spark, folder, pattern), product).where(F.col("product") != "")
    best = found.agg(F.max(F.struct("modified", "product")).alias("best")).first()["best"]
    if best is None:
        raise MissingSource(f"no product in {folder}")
    return best["product"]

"""Feature-matrix sinks and reading a matrix back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import MissingSource, _exists


def write_matrix(
    df: DataFrame,
    folder: str,
    suffix: str = "",
    formats: Sequence[str] = ("parquet", "csv"),
    files: int | None = None,
) -> dict[str, str]:
    """Write a feature matrix, overwriting; returns the output paths.

    The partitions of the plan are kept. ``files`` merges them into fewer output files,
    which also lowers the parallelism of the last stage. With both formats the plan runs
    once: the CSV is made from the Parquet just written.
    """
    unknown = set(formats) - {"parquet", "csv"}
    if unknown:
        raise ValueError(f"unknown output formats {sorted(unknown)}")
    out = df if files is None else df.coalesce(files)
    paths: dict[str, str] = {}
    if "parquet" in formats:
        paths["parquet"] = f"{folder}/feature_matrix{suffix}.parquet"
        out.write.mode("overwrite").parquet(paths["parquet"])
        written = df.sparkSession.read.parquet(paths["parquet"])
        out = written if files is None else written.coalesce(files)
    if "csv" in formats:
        paths["csv_dir"] = f"{folder}/feature_matrix{suffix}_csv"
        out.write.mode("overwrite").option("header", True).csv(paths["csv_dir"])
    return paths


def read_matrix(spark: SparkSession, folder: str, suffix: str, schema=None) -> DataFrame:
    """Exactly the named product: its Parquet folder, or its CSV folder with a given schema."""
    parquet = f"{folder}/feature_matrix{suffix}.parquet"
    if _exists(spark, parquet):
        return spark.read.parquet(parquet)
    csv = f"{folder}/feature_matrix{suffix}_csv"
    if _exists(spark, csv):
        if schema is None:
            return spark.read.option("header", True).option("inferSchema", True).csv(csv)
        return spark.read.schema(schema).option("header", True).csv(csv)
    raise MissingSource(f"no feature matrix {suffix or '(plain)'} in {folder}")


def newest_matrix(spark: SparkSession, folder: str, pattern: str = "feature_matrix*_csv") -> str:
    """Folder of the most recently written CSV product."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(root)
    if not found:
        raise MissingSource(f"no {pattern} in {folder}")
    return max(found, key=lambda status: status.getModificationTime()).getPath().toString()


def read_any_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical CSV product, else the newest CSV product, else the Parquet product."""
    reader = spark.read.option("header", True).option("inferSchema", True)
    canonical = f"{folder}/feature_matrix_csv"
    if _exists(spark, canonical):
        return reader.csv(canonical)
    try:
        return reader.csv(newest_matrix(spark, folder))
    except MissingSource:
        return read_matrix(spark, folder, "")


"""Source tables: explicit schemas, readers, typed conversion and bulk conversion."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.plans.products import CohortTables

# Column names of the raw tables, in file order.
RAW_COLUMNS = {
    "ADMISSIONS": [
        "ROW_ID", "SUBJECT_ID", "HADM_ID", "ADMITTIME", "DISCHTIME", "DEATHTIME", "ADMISSION_TYPE",
        "ADMISSION_LOCATION", "DISCHARGE_LOCATION", "INSURANCE", "LANGUAGE", "RELIGION",
        "MARITAL_STATUS", "ETHNICITY", "EDREGTIME", "EDOUTTIME", "DIAGNOSIS",
        "HOSPITAL_EXPIRE_FLAG", "HAS_CHARTEVENTS_DATA",
    ],
    "PATIENTS": ["ROW_ID", "SUBJECT_ID", "GENDER", "DOB", "DOD", "DOD_HOSP", "DOD_SSN", "EXPIRE_FLAG"],
    "ICUSTAYS": [
        "ROW_ID", "SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "DBSOURCE", "FIRST_CAREUNIT",
        "LAST_CAREUNIT", "FIRST_WARDID", "LAST_WARDID", "INTIME", "OUTTIME", "LOS",
    ],
    "CHARTEVENTS": [
        "ROW_ID", "SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "ITEMID", "CHARTTIME", "STORETIME", "CGID",
        "VALUE", "VALUENUM", "VALUEUOM", "WARNING", "ERROR", "RESULTSTATUS", "STOPPED",
    ],
    "LABEVENTS": [
        "ROW_ID", "SUBJECT_ID", "HADM_ID", "ITEMID", "CHARTTIME", "VALUE", "VALUENUM", "VALUEUOM", "FLAG",
    ],
}

# Typed projection as (source column, type, output name). "text" keeps the string.
TYPED_COLUMNS = {
    "ADMISSIONS": [
        ("subject_id", "bigint", "subject_id"), ("hadm_id", "bigint", "hadm_id"),
        ("admittime", "timestamp", "admittime"), ("deathtime", "timestamp", "deathtime"),
        ("hospital_expire_flag", "int", "hospital_expire_flag"),
    ],
    "PATIENTS": [("subject_id", "bigint", "subject_id"), ("gender", "text", "gender"), ("dob", "timestamp", "dob")],
    "ICUSTAYS": [
        ("subject_id", "bigint", "subject_id"), ("hadm_id", "bigint", "hadm_id"),
        ("icustay_id", "bigint", "icustay_id"), ("intime", "timestamp", "intime"),
        ("outtime", "timestamp", "outtime"), ("los", "double", "icu_los_days"),
    ],
    "CHARTEVENTS": [
        ("subject_id", "bigint", "subject_id"), ("hadm_id", "bigint", "hadm_id"),
        ("itemid", "int", "itemid"), ("charttime", "timestamp", "charttime"), ("valuenum", "double", "valuenum"),
    ],
    "LABEVENTS": [
        ("subject_id", "bigint", "subject_id"), ("hadm_id", "bigint", "hadm_id"),
        ("itemid", "int", "itemid"), ("charttime", "timestamp", "charttime"),
        ("valuenum", "double", "valuenum"), ("flag", "text", "flag"),
    ],
}
EVENT_TABLES = ("CHARTEVENTS", "LABEVENTS")
EVENT_FILE_ROWS = 5_000_000


class MissingSource(FileNotFoundError):
    """One or more required inputs are absent."""


def text_schema(columns: Sequence[str]) -> T.StructType:
    """Every column a nullable string."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def require_sources(spark: SparkSession, folder: str, names: Sequence[str] = tuple(RAW_COLUMNS), suffix: str = ".csv.gz") -> None:
    """Fail before any job with the names of all absent inputs, on any Hadoop file system."""
    absent = [f"{n}{suffix}" for n in names if not _exists(spark, f"{folder}/{n}{suffix}")]
    if absent:
        raise MissingSource(f"missing in {folder}: {', '.join(absent)}")


def read_csv_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header CSV (plain or compressed) with an explicit all-string schema, names lower-cased."""
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("mode", "PERMISSIVE")
    return lower_names(reader.csv(path))


def read_table(
    spark: SparkSession, folder: str, name: str, input_format: str = "csv", parquet_dir: str | None = None
) -> DataFrame:
    """Raw table by name. Parquet tables lie in ``parquet_dir`` or, without one, in ``folder``."""
    if name not in RAW_COLUMNS:
        raise ValueError(f"unknown table {name!r}; known: {sorted(RAW_COLUMNS)}")
    if input_format == "parquet":
        return lower_names(spark.read.parquet(f"{parquet_dir or folder}/{name}"))
    if input_format == "csv":
        return read_csv_table(spark, f"{folder}/{name}.csv.gz", RAW_COLUMNS[name])
    raise ValueError(f"input format must be csv or parquet, not {input_format!r}")


def typed(df: DataFrame, column: str, kind: str) -> Column:
    """Column of the wanted type; text that does not convert becomes null, never an error.

    A column that already has the type passes through unchanged, so filters on it still
    reach the Parquet scan.
    """
    have = df.schema[column].dataType
    if kind == "text":
        return F.col(column).cast("string")
    if not isinstance(have, T.StringType):
        return F.col(column) if kind == "timestamp" else F.col(column).cast(kind)
    return F.try_to_timestamp(F.col(column)) if kind == "timestamp" else F.col(column).try_cast(kind)


def typed_projection(
    df: DataFrame, columns: Sequence[tuple[str, str, str]], not_null: Sequence[str] = ()
) -> DataFrame:
    """The needed columns in their types, without rows whose ``not_null`` columns are null."""
    result = df.select(*[typed(df, name, kind).alias(out) for name, kind, out in columns])
    for name in not_null:
        result = result.where(F.col(name).isNotNull())
    return result


def _typed_tables(named: Callable[[str], DataFrame]) -> CohortTables:
    """The five typed tables, from raw tables or from ones stored typed."""

    def table(name: str) -> DataFrame:
        raw = named(name)
        stored = [
            (out if out in raw.columns and source not in raw.columns else source, kind, out)
            for source, kind, out in TYPED_COLUMNS[name]
        ]
        return typed_projection(raw, stored, ["hadm_id"] if name in EVENT_TABLES else [])

    return CohortTables(*[table(n) for n in ("ADMISSIONS", "PATIENTS", "ICUSTAYS", "CHARTEVENTS", "LABEVENTS")])


def load_tables(
    spark: SparkSession, folder: str, input_format: str = "csv", parquet_dir: str | None = None
) -> CohortTables:
    """The five typed tables; nothing is cached, so filters and pruning reach the files."""
    if input_format == "csv":
        require_sources(spark, folder)

    return _typed_tables(lambda name: read_table(spark, folder, name, input_format, parquet_dir))


def convert_to_parquet(
    spark: SparkSession,
    source: str,
    target: str,
    names: Sequence[str] = tuple(RAW_COLUMNS),
    as_typed: bool = False,
    file_rows: Mapping[str, int] | None = None,
) -> None:
    """Rewrite CSV tables as Parquet, one folder per table, overwriting, without a shuffle.

    ``as_typed`` stores the typed projection, which lets code and value filters reach the
    scan of every later run.
    """
    limits = {name: EVENT_FILE_ROWS for name in EVENT_TABLES} if file_rows is None else file_rows
    require_sources(spark, source, names)
    for name in names:
        df = read_table(spark, source, name)
        if as_typed:
            df = typed_projection(df, TYPED_COLUMNS[name])
        df.write.mode("overwrite").option("maxRecordsPerFile", limits.get(name, 0)).parquet(f"{target}/{name}")


# What tables are joined and grouped by, and what their rows are sorted by inside a bucket.
BUCKET_KEYS = {"PATIENTS": "subject_id"}
BUCKET_ORDER = {"CHARTEVENTS": ["itemid"], "LABEVENTS": ["itemid"]}


def convert_to_buckets(
    spark: SparkSession,
    source: str,
    target: str,
    buckets: int,
    prefix: str = "bucketed_",
    input_format: str = "csv",
    parquet_dir: str | None = None,
    names: Sequence[str] = tuple(RAW_COLUMNS),
) -> None:
    """Store typed tables in the catalogue, bucketed by admission (patients by patient) and sorted by admission and code.

    Joins of events to intervals and aggregates by admission then need no exchange, and a code
    list skips row groups, as codes lie together. One shuffle is paid here, once, and gives one file a bucket. Files
    lie under ``target``; tables of these names are replaced.
    """
    if input_format == "csv":
        require_sources(spark, source, names)
    for name in names:
        key = BUCKET_KEYS.get(name, "hadm_id")
        order = [key, *BUCKET_ORDER.get(name, [])]
        df = typed_projection(read_table(spark, source, name, input_format, parquet_dir), TYPED_COLUMNS[name])
        dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*order).mode("overwrite")
        dealt.option("path", f"{target}/{name}").format("parquet").saveAsTable(f"{prefix}{name.lower()}")


def load_buckets(spark: SparkSession, prefix: str = "bucketed_") -> CohortTables:
    """The typed tables that ``convert_to_buckets`` stored."""
    return replace(_typed_tables(lambda name: spark.table(f"{prefix}{name.lower()}")), colocated=True)

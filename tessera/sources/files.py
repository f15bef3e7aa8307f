"""Control files between the levels: readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a manifest, in order.
MANIFEST = ["fecha", "jornada", "lab", "turno", "color", "etiqueta", "archivo"]


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A CSV with header; a byte order mark and blanks around names go. columns picks those that exist."""
    rows = spark.read.option("header", True).option("encoding", encoding).csv(path)
    rows = rows.toDF(*[c.replace("﻿", "").strip() for c in rows.columns])
    return rows if columns is None else rows.select(*[c for c in columns if c in rows.columns])


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K4."""
    rows.write.mode(mode).option("header", True).csv(path)


def table_schema(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footer; no row is read."""
    return spark.read.parquet(path).columns


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON under a schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: a line of JSON each row."""
    rows.write.mode(mode).json(path)


def write_spectra(spectra: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K8: spectra as arrays of float."""
    spectra.withColumn("power", F.col("power").cast("array<float>")).write.mode(mode).parquet(path)


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """Spectra back as arrays of double."""
    rows = spark.read.parquet(path)
    return rows.withColumn("power", F.col("power").cast("array<double>"))


def write_by(rows: DataFrame, path: str, by: Sequence[str], kind: str = "csv", mode: str = "overwrite") -> None:
    """K6 and K7: a folder for each value of the keys, as of jkey or feature."""
    writer = rows.write.mode(mode).partitionBy(*by)
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """K10."""
    write_csv(rows.select(*MANIFEST), path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; a missing column raises."""
    rows = read_csv(spark, path)
    missing = [c for c in MANIFEST if c not in rows.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    return rows.select(*MANIFEST[:-1], F.col("archivo").try_cast("int").alias("archivo"))


def bounds_table(bounds: DataFrame, lab: str) -> DataFrame:
    """Time bounds keyed by measurement as rows; date and number come from the id."""
    rows = bounds.select(F.explode(F.map_entries("bounds")).alias("e")).select(F.col("e.key").alias("mid"), "e.value.*")
    return rows.withColumns({"fecha": F.split("mid", "_")[0], "lab": F.lit(lab), "m": F.regexp_extract("mid", r"_(-?\d+)$", 1).try_cast("int")})

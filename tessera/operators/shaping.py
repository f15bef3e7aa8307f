"""Small relational operators: labels, ids, redaction, plot series, schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def label_precedence(rows: DataFrame, labels: DataFrame, levels: Sequence[Sequence[str]], default: str = "UNK") -> DataFrame:
    """The label of the first level whose keys match; within a key the last labelled row (by row_no) wins; else the default."""
    out, found = rows, []
    for i, keys in enumerate(levels):
        others = [c for level in levels for c in level if c not in keys]
        own = labels.where(" and ".join([f"{k} is not null" for k in keys] + [f"{k} is null" for k in dict.fromkeys(others)]))
        own = own.groupBy(*keys).agg(F.max_by("label", "row_no").alias(f"__l{i}"))
        out = out.join(own, list(keys), "left")
        found.append(F.col(f"__l{i}"))
    return out.withColumn("label", F.coalesce(*found, F.lit(default))).drop(*[f"__l{i}" for i in range(len(found))])


def time_bounds(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and last value in order."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count("*").alias("n"))


def downsample(rows: DataFrame, most: int, keys: Sequence[str] = ("mid", "channel"), order: str = "idx") -> DataFrame:
    """At most `most` evenly spaced rows of each series. A row stays if an even position falls on it: no list of positions is made."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"__i": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count("*").over(w)})
    # position of the first even step at or after the row; floor of its place is the row itself if it stays
    step = F.ceil(F.col("__i") * (most - 1) / (F.col("__n") - 1))
    place = F.floor(step * (F.col("__n") - 1) / (most - 1))
    return rows.where((F.col("__n") <= most) | (place == F.col("__i"))).drop("__i", "__n")


def minmax(rows: DataFrame, keys: Sequence[str] = ("mid", "channel"), value: str = "value") -> DataFrame:
    """Scaled to 0..1 by series; a constant series is 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)))


def parse_ratio(cells: DataFrame, keys: Sequence[str], cell: Column) -> DataFrame:
    """Shares of cells that are times and numbers, and of steps that do not fall."""
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(S.hms_seconds(cell).isNotNull().cast("int")).alias("time_ratio"), F.avg(S.parse_float(cell).isNotNull().cast("int")).alias("number_ratio"))


def schema_rollup(files: DataFrame, group: Sequence[str], columns: str = "columns") -> DataFrame:
    """Files and distinct schema hashes of each group, and whether they agree."""
    rows = files.withColumn("hash", S.columns_hash(F.col(columns)))
    n = F.countDistinct("hash")
    return rows.groupBy(*group).agg(F.count("*").alias("n_files"), n.alias("n_schemas"), (n == 1).alias("consistent"))


def schema_checks(files: DataFrame, expected: DataFrame, keys: Sequence[str] = ("mid",)) -> DataFrame:
    """D8 by file: files (keys, columns) with both hashes and schema_ok: the columns are the expected ones in the same order. Without either side it is false."""
    want = expected.select(*keys, F.col("columns").alias("__want")).dropDuplicates(list(keys))
    rows = files.join(want, list(keys), "left")
    own = lambda c: F.when(F.col(c).isNotNull(), S.columns_hash(F.col(c)))
    return rows.select(*files.columns, own("columns").alias("actual_hash"), own("__want").alias("expected_hash"), F.coalesce(F.col("columns") == F.col("__want"), F.lit(False)).alias("schema_ok"))


def schema_groups(checks: DataFrame, group: Sequence[str] = ("fecha", "lab"), label: str = "label") -> DataFrame:
    """A7 over ``schema_checks``: files, sound and unsound ones, variants, consistent (one variant), labels_present (distinct, in order, UNK and null left out) and mixed_labels."""
    labels = F.array_sort(F.collect_set(F.when(F.col(label) != "UNK", F.col(label))))
    n = F.count_distinct(F.coalesce("actual_hash", F.lit("")))
    rows = checks.groupBy(*group).agg(F.count("*").alias("n_files"), F.count_if("schema_ok").alias("n_schema_ok"), F.count_if(~F.col("schema_ok")).alias("n_schema_fail"), n.alias("n_schema_variants"), labels.alias("labels"))
    return rows.select(*group, "n_files", "n_schema_ok", "n_schema_fail", "n_schema_variants", (F.col("n_schema_variants") == 1).alias("schema_consistent"), (F.size("labels") > 1).alias("mixed_labels"), F.array_join("labels", ",").alias("labels_present"))


def rank_average(value: str, keys: Sequence[str]) -> Column:
    """W10."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0

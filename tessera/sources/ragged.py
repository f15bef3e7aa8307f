"""Delimited files read in splits, with the rules of Python's csv.reader: quoted delimiters and line feeds, ragged rows.

Spark cuts files into splits at line feeds, wherever its readers reach. A split may begin inside a quoted field, so one pass finds for
each split how many records begin in it and whether it ends inside quotes, both if it begins outside and if it begins inside; folding that
over the splits of a file gives each split its state and the number of its first record. A second pass then cuts records. Only
records that cross a border between splits are put together by a shuffle. A file is never one row or one task.

A file whose lines are not all valid UTF-8 is read as Latin-1. A line feed ends a line, a carriage return before it is dropped
outside quotes; a lone carriage return does not end one.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = [",", ";", "\t", "|"]
_SPLIT = ["path", "start"]


@F.pandas_udf(T.ArrayType(T.StringType()))
def csv_fields(texts: pd.Series, delimiters: pd.Series) -> pd.Series:
    """Fields of one record each; null for null, no fields for blank text."""
    csv.field_size_limit(sys.maxsize)

    def cut(text: str | None, delimiter: str) -> list[str] | None:
        return None if text is None else next(csv.reader(text.splitlines(keepends=True), delimiter=delimiter), [])

    return pd.Series([cut(t, d) for t, d in zip(texts, delimiters, strict=True)], dtype=object)


def best_delimiter(line: str) -> str:
    """The delimiter that cuts a header into most fields; a comma if none does, the first of , ; TAB | on ties."""
    return max(DELIMITERS, key=lambda d: len(next(csv.reader([line], delimiter=d), [])))


class _Records:
    """Records of the lines of one split, in order; begins inside quotes or outside."""

    def __init__(self, lines: Iterator[str], inside: bool, delimiter: str):
        self.lines, self.inside, self.delimiter, self.taken, self.over = lines, inside, delimiter, [], False

    def _fed(self) -> Iterator[str]:
        """Lines for the reader, an opening quote before the first if they begin inside; lines without a quote cannot leave it and are passed by."""
        inside = self.inside
        for line in self.lines:
            self.taken.append(line)
            if inside and '"' not in line:
                continue
            yield ('"' if inside else "") + line + "\n"
            inside = False
        self.over = True

    def __iter__(self) -> Iterator[tuple[list[str] | None, list[str], bool]]:
        """Fields (None for the rest of a record from before), raw lines, and whether the record is open at the end."""
        fed = self._fed()
        reader = csv.reader(fed, delimiter=self.delimiter)
        rest = self.inside
        for row in reader:
            lines, self.taken = self.taken, []
            # a reader only looks past a record's last line if that is inside quotes: then the lines are over
            yield (None if rest else row), lines, self.over
            rest = False
        if self.taken:  # inside to the end
            yield None, self.taken, True


def _by_split(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, Iterator[bytes]]]:
    """The first row of each split, and an iterator over its lines; rows of a split follow each other."""
    held: list = []

    def rows() -> Iterator:
        for pdf in batches:
            yield from pdf.itertuples(index=False)

    source = rows()
    first = next(source, None)
    while first is not None:
        held = []

        def lines(first=first, held=held) -> Iterator[bytes]:
            row = first
            while row is not None and (row.path, row.start) == (first.path, first.start):
                yield row.line
                row = next(source, None)
            held.append(row)

        own = lines()
        yield first, own
        for _ in own:
            pass
        first = held[0]


def _text(line: bytes, encoding: str) -> str:
    return line.decode(encoding).removesuffix("\r") if b'"' not in line else line.decode(encoding)


def raw_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.csv") -> DataFrame:
    """path, start (of the split), at (place within it) and line (bytes)."""
    rows = spark.read.option("lineSep", "\n").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    return rows.withColumn("at", F.monotonically_increasing_id())


def _headers(lines: DataFrame) -> DataFrame:
    """path, delimiter: from the first line of each file."""
    head = lines.where("start = 0").groupBy("path").agg(F.min_by("line", "at").alias("line"))

    @F.pandas_udf("string")
    def sniffed(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: best_delimiter(x.decode("latin-1").removeprefix("ï»¿").rstrip("\r")))

    return head.select("path", sniffed("line").alias("delimiter"))


def _states(lines: DataFrame) -> DataFrame:
    """path, start, inside, first (number of the first record that begins there) and encoding of every split."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for split, own in _by_split(batches):
            kept = [x.decode("latin-1") for x in own]  # quotes and delimiters are the same bytes in both encodings
            ends, begun = [], []
            for inside in (False, True):
                n, open_ = 0, inside
                for fields, _, last in _Records((x.removesuffix("\r") if '"' not in x else x for x in kept), inside, split.delimiter):
                    n += fields is not None
                    open_ = last
                ends.append(open_)
                begun.append(n)
            yield pd.DataFrame([(split.path, split.start, *ends, *begun)], columns=["path", "start", "end_out", "end_in", "n_out", "n_in"])

    splits = lines.mapInPandas(work, "path string, start long, end_out boolean, end_in boolean, n_out long, n_in long")
    valid = lines.groupBy(*_SPLIT).agg(F.bool_and(F.is_valid_utf8(F.col("line").cast("string"))).alias("valid"))
    splits = splits.join(valid, _SPLIT)
    rows = splits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end_out", "end_in", "n_out", "n_in"))).alias("s"), F.bool_and("valid").alias("valid"))
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("first"), F.array().cast("array<struct<start:bigint,inside:boolean,first:bigint>>").alias("out"))

    def step(acc, x):
        own = F.struct(x["start"].alias("start"), acc["inside"].alias("inside"), acc["first"].alias("first"))
        return F.struct(F.when(acc["inside"], x["end_in"]).otherwise(x["end_out"]).alias("inside"), (acc["first"] + F.when(acc["inside"], x["n_in"]).otherwise(x["n_out"])).alias("first"), F.array_append(acc["out"], own).alias("out"))

    folded = rows.select("path", F.when(F.col("valid"), "utf-8").otherwise("latin-1").alias("encoding"), F.explode(F.aggregate("s", begin, step)["out"]).alias("o"))
    return folded.select("path", "encoding", "o.start", "o.inside", "o.first")


def records(spark: SparkSession, path: str | Sequence[str], delimiter: str | None = None, glob: str = "*.csv") -> DataFrame:
    """path, row (from 0, blank ones counted) and f (fields) of every record below path. delimiter: found by file if None."""
    lines = raw_lines(spark, path, glob)
    lines = lines.withColumn("delimiter", F.lit(delimiter)) if delimiter else lines.join(_headers(lines), "path")
    lines = lines.sortWithinPartitions(*_SPLIT, "at")
    states = _states(lines.select("path", "start", "line", "delimiter"))
    # whichever way this joins, a split stays whole
    own = lines.join(states, _SPLIT).sortWithinPartitions(*_SPLIT, "at").select("path", "start", "line", "delimiter", "inside", "first", "encoding")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        names = ["path", "row", "start", "f", "part", "delimiter"]
        for split, found in _by_split(batches):
            out, row = [], split.first
            texts = (_text(x, split.encoding) for x in found)
            if split.start == 0:
                texts = (x.removeprefix("﻿" if split.encoding == "utf-8" else "ï»¿") if i == 0 else x for i, x in enumerate(texts))
            for fields, raw, open_ in _Records(texts, bool(split.inside), split.delimiter):
                if fields is None:
                    out.append((split.path, row - 1, split.start, None, "\n".join(raw), split.delimiter))
                    continue
                out.append((split.path, row, split.start, None if open_ else fields, "\n".join(raw) if open_ else None, split.delimiter))
                row += 1
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    found = own.mapInPandas(work, "path string, row long, start long, f array<string>, part string, delimiter string")
    whole = found.where("part is null").select("path", "row", "f")
    broken = found.where("part is not null").groupBy("path", "row", "delimiter").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return whole.unionByName(broken.select("path", "row", csv_fields("text", "delimiter").alias("f")))


def table(found: DataFrame, allow_extra: bool = True) -> DataFrame:
    """S3: path, row, header and f of data records as wide as the header; one trailing field more is cut off, other records and blank ones are left out."""
    head = found.where("row = 0").select("path", F.col("f").alias("header"))
    rows = found.where("row > 0").join(head, "path")
    n = F.size("header")
    keep = F.when(F.size("f") == n, F.col("f")).when(F.lit(allow_extra) & (F.size("f") == n + 1), F.slice("f", F.lit(1), n))
    return rows.select("path", "row", "header", keep.alias("f")).where(F.col("f").isNotNull() & (n > 0))


def widths(found: DataFrame) -> DataFrame:
    """D3: path, header width, most frequent width of data records (the first on ties) and how many have another width than the header."""
    rows = found.select("path", "row", F.size("f").alias("w"))
    by = rows.where("row > 0").groupBy("path", "w").agg(F.count("*").alias("k"), F.min("row").alias("at"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("k"), "at"))
    head = rows.where("row = 0").select("path", F.col("w").alias("header_ncols"))
    own = by.withColumn("r", rank).join(head, "path")
    return own.groupBy("path", "header_ncols").agg(F.max(F.when(F.col("r") == 1, F.col("w"))).alias("mode_ncols"), F.sum(F.when(F.col("w") != F.col("header_ncols"), F.col("k")).otherwise(0)).alias("bad_rows"))

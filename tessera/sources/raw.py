"""Raw measurement trees: discovery, ragged delimited files, archives, plan, dialect, roles, bounds, tables.

Files are read through Spark (`binaryFile`, text), so any store that Spark reaches works; a file is one row until it is cut into lines.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ragged import DELIMITERS, csv_fields

DATE_DIR = r"^\d{2}[A-Za-z]{3}\d{2}$"


class DiscoveryError(ValueError):
    pass


def discover(spark: SparkSession, root: str, dates: Sequence[str] | None = None, labs: Sequence[str] | None = None) -> DataFrame:
    """Date, lab, name, path and content of every CSV below root/date/lab, one row a path; no file found raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(root)
    tail = F.split(F.regexp_replace("path", r"^.*?" + re.escape(root.rstrip("/")) + "/", ""), "/")
    rows = files.select(F.get(tail, 0).alias("date"), F.get(tail, 1).alias("lab"), F.element_at(tail, -1).alias("name"), "path", "content")
    rows = rows.where(F.col("date").rlike(DATE_DIR) & (F.size(tail) >= 3)).dropDuplicates(["path"])
    for column, wanted in (("date", dates), ("lab", labs)):
        if wanted is not None:
            rows = rows.where(F.col(column).isin(list(wanted)))
    if rows.isEmpty():
        raise DiscoveryError(f"no measurement below {root}")
    return rows


def archive_members(files: DataFrame, labs: Mapping[str, str]) -> DataFrame:
    """Path, name, date (as 04Mar26), lab, content and error of the CSV members of csv_raw folders of archives (path, content) and of archives inside them.

    labs: what a path holds (lower case) and the laboratory it stands for; else a member has that of the archive it is in, or Unknown. The
    first date YYYY-MM-DD in a member's name counts, else that of the archive it is in, or null. A damaged archive or member gives a row
    with an error instead of content. Members go on one by one; a task holds one archive of each level and one member.
    """
    known = dict(labs)

    def day(name: str) -> str | None:
        found = re.search(r"(\d{4})-(\d{2})-(\d{1,2})", name)
        try:
            return datetime.date(*map(int, found.groups())).isoformat() if found else None
        except ValueError:
            return None

    def lab_of(path: str) -> str | None:
        return next((lab for part, lab in known.items() if part in path.lower()), None)

    def walk(data: bytes, at: str, date: str | None, lab: str | None) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            yield at, at.rsplit("/", 1)[-1], date, lab, None, "damaged_archive"
            return
        for name in archive.namelist():
            low, inner = name.lower(), (f"{at}/{name}", day(name) or date, lab_of(f"{at}/{name}") or lab)
            if not (low.endswith(".zip") or ("csv_raw/" in low and low.endswith(".csv"))):
                continue
            try:
                member = archive.read(name)
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                yield inner[0], name.rsplit("/", 1)[-1], *inner[1:], None, "damaged_member"
                continue
            if low.endswith(".zip"):
                yield from walk(member, *inner)
            else:
                yield inner[0], name.rsplit("/", 1)[-1], *inner[1:], member, None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                for row in walk(data or b"", path, day(path.rsplit("/", 1)[-1]), lab_of(path)):
                    yield pd.DataFrame([row], columns=["path", "name", "day", "lab", "content", "error"])

    rows = files.select("path", "content").mapInPandas(work, "path string, name string, day string, lab string, content binary, error string")
    return rows.select("path", "name", F.date_format(F.to_date("day"), "ddMMMyy").alias("date"), F.coalesce("lab", F.lit("Unknown")).alias("lab"), "content", "error")


def organised(members: DataFrame) -> DataFrame:
    """Members with a place in the raw tree, month/date/lab/Raw Data/name; status undated or damaged without one.

    Of members with one place the last path counts, as if each overwrote the one before; the others have status replaced.
    """
    month = F.substring("date", 3, 5)
    place = F.when(F.col("error").isNull(), F.concat_ws("/", month, "date", "lab", F.lit("Raw Data"), "name"))
    status = F.when(F.col("error").isNotNull(), "damaged").when(F.col("date").isNull(), "undated")
    rows = members.withColumn("target", F.when(F.col("date").isNotNull(), place)).withColumn("status", status)
    last = rows.where("target is not null").groupBy("target").agg(F.max("path").alias("__last"))
    return rows.join(last, "target", "left").withColumn("status", F.coalesce("status", F.when(F.col("path") == F.col("__last"), "ok").otherwise("replaced"))).drop("__last")


def unzip(files: DataFrame) -> DataFrame:
    """Path and content of the members of csv_raw folders, dated or not; what is damaged gives no row."""
    return archive_members(files, {}).where("error is null").select("path", "content")


def lines_of(files: DataFrame) -> DataFrame:
    """path, row (from 0), line: text lines without the byte order mark; bad bytes are replaced."""
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    return files.select(*[c for c in files.columns if c != "content"], F.posexplode(F.split(text, "\r?\n")).alias("row", "line"))


def sniff(lines: DataFrame) -> DataFrame:
    """Path and the delimiter that cuts the header into most fields; a comma if none cuts it. Ties go to the first in , ; TAB |."""
    head = lines.where("row = 0")
    n = [F.size(csv_fields("line", F.lit(d))) for d in DELIMITERS]
    best = F.greatest(*n)
    choice = None
    for d, k in zip(DELIMITERS, n, strict=True):
        choice = (F.when if choice is None else choice.when)(k == best, F.lit(d))
    return head.select("path", choice.alias("delimiter"))


def fields(line: Column, delimiter: Column) -> Column:
    """Fields of a line by csv rules: quotes are taken off, and delimiters inside them kept."""
    return F.transform(csv_fields(line, delimiter), lambda x: F.trim(x))


def cells(lines: DataFrame, allow_extra: bool = True) -> DataFrame:
    """S3 of lines (``ragged`` reads quoted line feeds): path, row, fields of data rows as wide as the header; one trailing field more is cut off, other rows and blank ones are left out."""
    rows = lines.join(sniff(lines), "path").where(F.trim("line") != "").withColumn("f", fields(F.col("line"), F.col("delimiter")))
    head = rows.where("row = 0").select("path", F.col("f").alias("header"))
    rows = rows.where("row > 0").join(head, "path")
    n = F.size("header")
    keep = F.when(F.size("f") == n, F.col("f")).when(F.lit(allow_extra) & (F.size("f") == n + 1), F.slice("f", F.lit(1), n))
    return rows.select("path", "row", "header", keep.alias("f")).where("f is not null")


def dialect(lines: DataFrame, most: int = 200) -> DataFrame:
    """D3: header width, modal width, rows of other width (blank ones have width 0) and whether one constant extra field shows, over the first rows."""
    rows = lines.where(F.col("row") <= most).join(sniff(lines), "path")
    width = F.when(F.trim("line") == "", 0).otherwise(F.size(fields(F.col("line"), F.col("delimiter"))))
    rows = rows.select("path", "row", "delimiter", width.alias("w"), F.element_at(fields(F.col("line"), F.col("delimiter")), -1).alias("last"))
    head = rows.where("row = 0").select("path", "delimiter", F.col("w").alias("header_ncols"))
    by = rows.where("row > 0").groupBy("path", "w").agg(F.count("*").alias("k"), F.min("row").alias("at"))
    mode = by.groupBy("path").agg(F.max_by("w", F.struct("k", -F.col("at"))).alias("mode_ncols"), F.sum("k").alias("n"))
    bad = by.join(head, "path").groupBy("path").agg(F.sum(F.when(F.col("w") != F.col("header_ncols"), F.col("k")).otherwise(0)).alias("bad_rows"))
    extra = rows.where("row > 0").join(head.select("path", "header_ncols"), "path").where("w = header_ncols + 1").where(F.col("row") <= 10).groupBy("path", "last").count()
    extra = extra.groupBy("path").agg(F.max("count").alias("same"), F.sum("count").alias("seen"), F.max_by("last", "count").alias("extra_value"))
    out = head.join(mode, "path", "left").join(bad, "path", "left").join(extra, "path", "left")
    constant = (F.col("mode_ncols") == F.col("header_ncols") + 1) & (F.col("same") >= F.greatest(F.lit(3), F.floor(0.8 * F.col("seen"))))
    return out.select("path", "delimiter", "header_ncols", "mode_ncols", "bad_rows", F.coalesce(constant, F.lit(False)).alias("extra_field"), F.when(constant, F.col("extra_value")).alias("extra_value"))


def roles(data: DataFrame, rows: int = 80, ratio: float = 0.8) -> DataFrame:
    """Path, position, name and role (t_rel, t_sys, channel or null) from parse ratios over the first rows; t_rel starts within 5 s and does not fall."""
    cell = data.where(F.col("row") <= rows).select("path", "row", "header", F.posexplode("f").alias("i", "x"))
    cell = cell.withColumns({"name": F.get("header", F.col("i")), "s": S.hms_seconds(F.col("x")), "v": S.parse_float(F.col("x"))})
    step = F.col("s") >= F.lag("s").over(Window.partitionBy("path", "i").orderBy("row"))
    own = cell.withColumn("up", step.cast("int")).groupBy("path", "i", "name").agg(F.count("s").alias("ok"), F.avg(F.col("s").isNotNull().cast("int")).alias("t"), F.avg(F.col("v").isNotNull().cast("int")).alias("num"), F.coalesce(F.avg("up"), F.lit(0.0)).alias("mono"), F.min_by("s", "row").alias("start"))
    time = (F.col("t") >= ratio) & (F.col("ok") >= 5)
    score = F.when(time, F.col("mono") + F.when(F.col("start") <= 5, 1).otherwise(0))
    place = F.row_number().over(Window.partitionBy("path").orderBy(score.desc_nulls_last(), "i"))
    own = own.withColumns({"score": score, "r": place})
    role = F.when(F.col("score").isNotNull() & (F.col("r") == 1), "t_rel").when(F.col("score").isNotNull() & (F.col("r") == 2), "t_sys").when(F.col("score").isNull() & (F.col("num") >= ratio), "channel")
    return own.select("path", "i", "name", role.alias("role"))


def signal_table(data: DataFrame, role: DataFrame, *sentinels: float) -> DataFrame:
    """Path, idx, t_rel (seconds), channel, value: long table of the channels in order; the sentinel and blanks are null."""
    cell = data.select("path", "row", F.posexplode("f").alias("i", "x")).join(role.where("role is not null"), ["path", "i"])
    when = F.max(F.when(F.col("role") == "t_rel", S.hms_seconds(F.col("x")))).over(Window.partitionBy("path", "row"))
    cell = cell.withColumn("t_rel", when).where("role = 'channel'")
    number = F.dense_rank().over(Window.partitionBy("path").orderBy("i"))
    return cell.select("path", (F.col("row") - 1).alias("idx"), "t_rel", F.concat(F.lit("Laser_"), number).alias("channel"), S.without_sentinel(S.to_float(F.col("x")), *sentinels).alias("value"))


def plan(files: DataFrame) -> DataFrame:
    """D1 with F8, F9, W11: index from the name, else a counter by (date, lab) in order of name; ids stay unique."""
    rows = files.select("date", "lab", "name", "path", S.index_prefix(F.col("name")).alias("k"), S.colour_token(F.col("name")).alias("color"))
    own = Window.partitionBy("date", "lab")
    count = F.row_number().over(Window.partitionBy("date", "lab", F.col("k").isNull()).orderBy("name"))
    rows = rows.withColumn("archivo", F.coalesce("k", F.coalesce(F.max("k").over(own), F.lit(0)) + count))
    return rows.withColumn("mid", S.mid(F.col("date"), F.col("lab"), F.col("archivo"))).drop("k")


def write_table(signal: DataFrame, path: str, by: Sequence[str] = ("fecha", "lab"), mode: str = "overwrite", row_group: int = 50_000) -> None:
    """K1-K3: partitioned Parquet in row groups of so many rows at most; mode ignore skips what exists, errorifexists raises."""
    signal.write.mode(mode).option("parquet.block.row.count.limit", str(row_group)).partitionBy(*by).parquet(path)

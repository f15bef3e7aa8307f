"""Ragged delimited files in splits against csv.reader: quoted delimiters and line feeds, files larger than a split, encodings."""

import csv
import io
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.sources import ragged, raw


def expected(data: bytes, delimiter: str):
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    return list(csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=delimiter))


def field(rng):
    kind = rng.randint(0, 9)
    if kind < 5:
        return str(rng.randint(0, 9999))
    if kind < 7:
        return '"' + rng.choice(['a,b', 'x;y', 'say ""hi""', 'two\nlines', 'three\r\nmore\n\nlines', ',', '']) + '"'
    return rng.choice(['5" pipe', "plain", "", " spaced ", "Ñandú"])


@pytest.mark.parametrize("size", [64, 300, 1 << 20])
def test_records_match_csv_reader(spark, tmp_path, size):
    rng = random.Random(size)
    want = {}
    for i in range(4):
        d = ",;\t|"[i]
        lines = [d.join(["Time", "A", '"B;,"', "C"])]
        for _ in range(120):
            lines.append("" if rng.random() < 0.05 else d.join(field(rng) for _ in range(rng.choice([4, 4, 4, 5, 3]))))
        data = ("﻿" if i == 0 else "") + ("\r\n" if i % 2 else "\n").join(lines) + ("\n" if i else "")
        data = data.encode("latin-1" if i == 3 else "utf-8")
        (tmp_path / f"{i}.csv").write_bytes(data)
        want[f"{i}.csv"] = expected(data, d)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        rows = ragged.records(spark, str(tmp_path)).collect()
        if size == 64:
            assert ragged.raw_lines(spark, str(tmp_path)).select("path", "start").distinct().count() > 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, records in want.items():
        got = sorted((r.row, r.f) for r in rows if r.path.endswith(name))
        assert [r for r, _ in got] == list(range(len(records)))
        assert [f for _, f in got] == records


def test_open_quote_to_the_end(spark, tmp_path):
    data = b'a,b\n1,"never closed\n2,3\n' + b"4,5\n" * 50
    (tmp_path / "x.csv").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    try:
        got = [r.f for r in ragged.records(spark, str(tmp_path), ",").orderBy("row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = expected(data, ",")
    assert got[0] == want[0] and got[1][0] == "1" and got[1][1].rstrip("\n") == want[1][1].rstrip("\n") and len(got) == 2


def test_table_and_widths(spark, tmp_path):
    text = 'T,A,B\n1,"2,5",3\n\n4,5\n6,7,8,extra\n9,"a\nb",1\n'
    (tmp_path / "d.csv").write_text(text)
    found = ragged.records(spark, str(tmp_path))
    rows = ragged.table(found).orderBy("row").collect()
    assert [(r.row, r.f) for r in rows] == [(1, ["1", "2,5", "3"]), (4, ["6", "7", "8"]), (5, ["9", "a\nb", "1"])]
    assert [r.f for r in ragged.table(found, allow_extra=False).orderBy("row").collect()] == [["1", "2,5", "3"], ["9", "a\nb", "1"]]
    w = ragged.widths(found).first()
    assert (w.header_ncols, w.mode_ncols, w.bad_rows) == (3, 3, 3)


def test_line_based_fields_keep_quotes(spark):
    rows = spark.createDataFrame([('1,"2,5",3', ","), ('a|"b|c"', "|")], "line string, delimiter string")
    assert [r[0] for r in rows.select(raw.fields(F.col("line"), F.col("delimiter"))).collect()] == [["1", "2,5", "3"], ["a", "b|c"]]


def test_row_groups(spark, tmp_path):
    frame = spark.range(0, 2500, 1, 1).select(F.col("id").cast("double").alias("v"), F.lit("d").alias("fecha"), F.lit("l").alias("lab"))
    raw.write_table(frame, f"{tmp_path}/t", row_group=1000)
    file = next((tmp_path / "t" / "fecha=d" / "lab=l").glob("*.parquet"))
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1000, 1000, 500]
    raw.write_table(frame.limit(0), f"{tmp_path}/t", mode="ignore")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2500

"""Contracts, control files and joins between the levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import BinsPolicy
from tessera.operators import inference, relational, spectral, states
from tessera.sources import files


def test_projections(spark):
    rows = spark.createDataFrame([(1, "a", 2.0)], "x int, laboratorio string, Ch1 double")
    assert relational.by_position(rows, {2: "v", 0: "i"}).columns == ["v", "i"]
    with pytest.raises(ValueError):
        relational.by_position(rows, {9: "v"})
    assert relational.channel_columns(rows) == ["Ch1"] and relational.channel_columns(rows, ["Ch2", "Ch1"]) == ["Ch1"]
    assert relational.renamed(rows).columns == ["x", "lab", "Ch1"] and relational.reordered(rows, ["Ch1"]).columns[0] == "Ch1"
    with pytest.raises(ValueError):
        relational.with_mid(rows)
    assert relational.time_column(["time", "t_sys"]) == "t_sys"


def test_statuses(spark):
    queue = spark.createDataFrame([("d_l_001", 1), ("d_l_002", 2), ("d_l_003", 3)], "mid string, archivo int")
    listing = spark.createDataFrame([("d_l_001.parquet", "p1"), ("01.parquet", "p0"), ("002.parquet", "p2")], "name string, path string")
    got = {r.mid: (r.parquet_path, r.status) for r in relational.table_paths(queue, listing).collect()}
    assert got == {"d_l_001": ("p1", "ok"), "d_l_002": ("p2", "ok"), "d_l_003": (None, "parquet_missing")}
    s = spark.range(1).select(relational.action_status(F.lit(True), F.lit(True), F.lit(None)).alias("a"), relational.action_status(F.lit(False), F.lit(False), F.lit(None)).alias("b"), relational.action_status(F.lit(False), F.lit(True), F.lit("x")).alias("c")).first()
    assert tuple(s) == ("skipped_exists", "skipped_missing_raw", "error")


def test_control_files(spark, tmp_path):
    rows = spark.createDataFrame([("01Ene24", "UNK", "L1", None, "red", "LB", 3)], "fecha string, jornada string, lab string, turno string, color string, etiqueta string, archivo int")
    files.write_manifest(rows, f"{tmp_path}/m")
    assert files.read_manifest(spark, f"{tmp_path}/m").collect() == rows.collect()
    files.write_json(rows, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first()["archivo"] == 3
    files.write_by(rows, f"{tmp_path}/by", ["lab"])
    assert (tmp_path / "by" / "lab=L1").is_dir()
    (tmp_path / "bom.csv").write_text("﻿a , b\n1,2\n", "utf-8")
    assert files.read_csv(spark, f"{tmp_path}/bom.csv", ["b", "zz"]).columns == ["b"]
    with pytest.raises(ValueError):
        files.read_manifest(spark, f"{tmp_path}/bom.csv")
    power = spark.createDataFrame([(1, "c", [1.0, 2.0])], "mid int, channel string, power array<double>")
    files.write_spectra(power, f"{tmp_path}/s")
    assert files.read_spectra(spark, f"{tmp_path}/s").collect() == power.collect()


def test_spectra_cases(spark):
    assert spectral.block_starts(10, 4, 1) == [3] and spectral.block_starts(3, 4, 2) == [] and spectral.block_starts(10, 4, 3) == [0, 3, 6]
    random = spectral.block_starts(1000, 4, 8, "random", "m")
    assert random == sorted(set(random)) == spectral.block_starts(1000, 4, 8, "random", "m")
    rows = spark.createDataFrame([(1, "c", [1.0, 2.0, float("nan"), 5.0]), (2, "c", [float("nan")] * 4)], "mid int, channel string, samples array<double>")
    got = {r.mid: r.power for r in spectral.padded_spectrum(rows, 8).collect()}
    x = np.array([1.0, 2.0, 5.0])
    assert np.allclose(got[1], np.abs(np.fft.rfft(x - x.mean(), 8)) ** 2 / 8) and got[2] is None
    grids = spark.createDataFrame([(1, "c", [1.0, 2.0]), (2, "c", [1.0])], "mid int, channel string, power array<double>")
    with pytest.raises(spectral.ContractError):
        spectral.same_grid(grids)
    edges = spark.createDataFrame([("c", [0.0, 0.25, 0.5])], "channel string, edges array<double>")
    bad = states.full_spectrum(rows.where("mid = 2"))
    assert [r.prob for r in spectral.band_energy(bad, edges, 4).orderBy("band").collect()] == [1.0, 0.0]
    with pytest.raises(spectral.ContractError):
        spectral.sampling_rate(0)
    assert spark.range(1).select(spectral.edge_problem(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == "not_increasing"


def test_permutations_match_a_loop():
    rng = np.random.default_rng(4)
    values, labels = rng.normal(size=12), np.repeat([0, 1, 2], 4)
    many = np.stack([rng.permutation(labels) for _ in range(50)])
    med = [[np.median(values[row == k]) for k in range(3)] for row in many]
    assert np.allclose(inference.median_gaps(values, many), np.ptp(np.array(med), axis=1))
    assert BinsPolicy().validate()

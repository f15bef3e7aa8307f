import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import BinsPolicy, ConfigError, ProfilePolicy, QualityPolicy
from tessera.functions import scalars as S
from tessera.operators import bins, inference, profiles, quality, shaping, states


def one(spark, f, *values):
    rows = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in rows.select(f(F.col("s"))).collect()]


def test_parsing(spark):
    assert one(spark, S.to_float, " 1.5 ", "nan", "", "1d", "abc", None, "-inf") == [1.5, None, None, None, None, None, -math.inf]
    assert one(spark, S.parse_float, "inf", "2e3") == [None, 2000.0]
    assert one(spark, S.hms_seconds, "01:02:03.5", "1:60:00", "x:1:2", "30:00:60") == [3723.5, None, None, 108060.0]
    assert one(spark, S.safe_int, "1.0", "x", None) == [1, -1, -1]
    assert one(spark, S.index_prefix, "07medrojo.csv", "rojo.csv") == [7, None]
    assert one(spark, S.colour_token, "07medRojo.csv", "xmedRojo.csv") == ["rojo", None]
    assert one(spark, S.laser_index, "Laser_1b2", "Ch", "Ch0") == [12, None, None]
    assert [str(d) for d in one(spark, S.date_token, "03Ene24", "15aug25", "99Xyz11")] == ["2024-01-03", "2025-08-15", "None"]
    assert one(spark, S.lab_of_path, "/a/Lab 3/x", "/b") == ["LAB3", "LAB_UNK"]
    assert one(spark, S.is_true, "Sí", "no", None) == [True, False, False]


def test_guards(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (10.0, 1.0)], "m double, s double")
    assert [r[0] for r in rows.select(S.snr_db(F.col("m"), F.col("s"))).collect()] == [math.inf, -math.inf, 20.0]
    edges = F.array(*[F.lit(float(x)) for x in (0, 1, 2)])
    x = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,), (9.0,), (float("nan"),)], "x double")
    assert [r[0] for r in x.select(S.bin_index(edges, F.col("x"))).collect()] == [0, 0, 1, 1, 1, 1]


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"lab": "a", "mid": 1, "channel": np.repeat(["x", "y", "few"], [40, 40, 4]), "idx": [*range(40), *range(40), *range(4)], "value": rng.random(84)})
    pdf.loc[pdf.channel == "y", "value"] = 2.0
    pdf.loc[3, "value"] = -111.0
    got = quality.channel_metrics(spark.createDataFrame(pdf)).toPandas().set_index("channel")
    x = pdf[(pdf.channel == "x") & (pdf.value != -111)].value.to_numpy()
    assert np.isclose(got.loc["x", "std"], x.std()) and np.isclose(got.loc["x", "slope"], np.polyfit(range(39), x, 1)[0]) and got.loc["x", "n"] == 39
    assert got.loc["y", "snr_db"] == math.inf and got.loc["y", "slope"] == 0
    assert got.loc["few", "status"] == "insufficient_samples" and pd.isna(got.loc["few", "score"])
    gated = quality.gate(spark.createDataFrame([(7.0, 4, 4), (float("nan"), 4, 4), (9.0, 3, 4), (7.0, None, None)], "score double, n_used int, n_required int"), 7.0)
    assert [r.passed for r in gated.collect()] == [True, False, False, False]


def test_profiles(spark):
    rows = spark.createDataFrame([(d, "l", m, c, float(c * m + d)) for d in (1, 2) for m in (1, 2, 3) for c in (1, 2, 3)], "fecha int, lab string, mid int, laser int, v double")
    base = profiles.canonical_base(rows, 3)
    assert base.count() == 18
    assert all(abs(r.r - 1) < 1e-9 for r in profiles.intra_block_corr(base, "spearman").collect())
    pair = profiles.pairwise(base).first()
    assert abs(pair["corr"] - 1) < 1e-9 and abs(pair["distance"] - math.sqrt(3)) < 1e-9
    flat = rows.withColumn("v", F.lit(1.0))
    assert profiles.intra_block_corr(flat).first()["r"] is None


def test_bins_and_states(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    signal = spark.createDataFrame(pd.DataFrame({"mid": 1, "channel": "c", "idx": range(500), "value": x}))
    e = bins.quantile_edges(signal, 8)
    lo, hi = np.quantile(x, [5e-4, 1 - 5e-4])
    want = np.quantile(np.clip(x, lo, hi), np.linspace(0, 1, 9))
    assert np.allclose(e.first()["edges"], want)
    merged = e.select(bins.merge_narrow(F.col("edges"), F.lit(0.5)).alias("m")).first()["m"]
    assert merged[0] == e.first()["edges"][0] and min(np.diff(merged)[:-1]) >= 0.5
    p = states.pmf(signal, e)
    assert abs(p.agg(F.sum("prob")).first()[0] - 1) < 1e-9
    assert 0 <= states.entropy(p).first()["h"] <= 3
    ties = spark.createDataFrame([(1, "c", i, 1.0 if i < 90 else 2.0) for i in range(100)], "mid int, channel string, idx int, value double")
    assert np.all(np.diff(bins.quantile_edges(ties, 8).first()["edges"]) > 0)
    v = spark.createDataFrame([(1, "c", np.sin(2 * np.pi * 5 * np.arange(64) / 64).tolist())], "mid int, channel string, samples array<double>")
    assert states.top_modes(states.psd(v, 64), 1).first()["f"] == 5


def test_inference(spark):
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "n int, p double")
    q = {r.n: r.q for r in inference.bh_fdr(p).collect()}
    assert np.allclose([q[i] for i in (1, 2, 3, 4)], [0.04, 0.16 / 3, 0.16 / 3, 0.5])
    rows = spark.createDataFrame([("a", l, 1, 2.0) for l in range(3)] + [("b", l, 1, 2.0) for l in range(3)], "lab string, laser int, n int, g_norm double")
    assert {r.dom for r in inference.dominance(rows).collect()} == {1.5}
    assert inference.permutation_test(rows, n_perm=50).first()["p"] == 1.0


def test_shaping(spark):
    rows = spark.range(1000).select(F.lit(1).alias("mid"), F.lit("c").alias("channel"), F.col("id").cast("int").alias("idx"), F.lit(3.0).alias("value"))
    assert sorted(r.idx for r in shaping.downsample(rows, 7).collect()) == np.linspace(0, 999, 7).astype(int).tolist()
    assert shaping.minmax(rows).agg(F.max("scaled")).first()[0] == 0.0


def test_policies():
    for bad in (QualityPolicy(weights=(1, 1, 1)), ProfilePolicy(corr_method="x"), BinsPolicy(support_q=0.6)):
        with pytest.raises(ConfigError):
            bad.validate()

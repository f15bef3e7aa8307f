"""Quantiles, supports and the bins contract against numpy: ties, outliers, dense spots, missing values, empty tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import BinsPolicy
from tessera.operators import bins, contract, ranks, states

SCHEMA = "mid int, channel string, idx int, value double"


def table(spark, **channels):
    rows = [(i % 3, c, i, None if x is None else float(x)) for c, xs in channels.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_quantiles(spark):
    rng = np.random.default_rng(3)
    spot = np.concatenate([rng.normal(size=300), 5 + 1e-9 * rng.random(300), [1e300, -1e300, 1e-300, 0.0, -0.0]])
    xs = {"normal": rng.normal(size=1001), "spot": spot, "powers": 2.0 ** -np.arange(200), "same": np.full(50, 2.5), "one": [7.0], "two": [1.0, 2.0], "ties": rng.integers(0, 4, 500), "holes": [1.0, None, math.nan, math.inf, 3.0]}
    at = [0.0, 0.0005, 0.1, 0.25, 0.5, 2 / 3, 0.999, 1.0]
    got = {r.channel: r for r in ranks.quantiles(ranks.counted(table(spark, **xs), ["channel"]), at).collect()}
    for c, x in xs.items():
        x = np.array([np.nan if v is None else v for v in x], float)
        x = x[np.isfinite(x)]
        assert got[c].n == len(x)
        assert np.allclose(got[c].q, np.quantile(x, at), rtol=1e-12, atol=0 if c == "powers" else 1e-300), c
    assert ranks.quantiles(ranks.counted(table(spark), ["channel"]), at).count() == 0


def test_quantiles_by_two_keys_with_own_shares(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 3, 400), "b": rng.choice(["x", "y"], 400), "value": rng.normal(size=400)})
    at = spark.createDataFrame([(a, b, [i / (a + 2) for i in range(a + 3)], -0.5, 0.5) for a in range(3) for b in "xy"], "a long, b string, at array<double>, lo double, hi double")
    counts = ranks.counted(spark.createDataFrame(pdf), ["a", "b"])
    for r in ranks.quantiles(counts, at, ["a", "b"], clip=("lo", "hi")).collect():
        x = np.clip(pdf[(pdf.a == r.a) & (pdf.b == r.b)].value.to_numpy(), -0.5, 0.5)
        assert np.allclose(r.q, np.quantile(x, np.linspace(0, 1, r.a + 3)))


def test_support_and_tail(spark):
    rng = np.random.default_rng(8)
    still = np.zeros(4000)
    still[1:3] = 1.0
    s = table(spark, walk=np.cumsum(rng.normal(size=3000)), still=still)
    got = {r.channel: r.support for r in bins.increment_support(s, BinsPolicy(increment_q=0.5)).collect()}
    rows = s.orderBy("channel", "mid", "idx").toPandas()
    dx = {c: np.concatenate([np.diff(g["value"]) for _, g in rows[rows.channel == c].groupby("mid")]) for c in ("walk", "still")}
    assert np.isclose(got["walk"], np.quantile(np.abs(dx["walk"]), 0.5))
    assert got["still"] == 1.0  # neither the quantile nor the deviation is above 0
    sixth = F.col("s")
    frame = spark.createDataFrame([(0.0, 2.0, 9.0)], "t double, s double, m double")
    assert frame.select(bins.tail_support(F.col("t"), sixth, F.col("m"))).first()[0] == 12.0


def numpy_edges(x, b, lo, hi, width):
    e = np.quantile(np.clip(x, lo, hi), np.linspace(0, 1, b + 1))
    for k in range(1, len(e)):
        e[k] = max(e[k], e[k - 1] + 1e-12) if e[k] <= e[k - 1] else e[k]
    kept = [e[0]]
    for v in e[1:-1]:
        if v - kept[-1] >= width:
            kept.append(v)
    return np.array([*kept, e[-1]])


def fd(x, n, lo, hi):
    a, b = np.quantile(x, [0.25, 0.75])
    return int(min(256, max(32, math.ceil((hi - lo) / (2 * (b - a) * n ** (-1 / 3))))))


def sigma(x):
    return 1.4826 * np.median(np.abs(x - np.median(x)))


def test_contract(spark):
    rng = np.random.default_rng(2)
    xs = {"a": rng.normal(size=6000), "b": np.round(rng.gamma(2, 3, 4500), 1)}
    s = table(spark, **xs)
    rows = s.orderBy("channel", "mid", "idx").toPandas()
    got = {r.channel: r for r in contract.contract(s).collect()}
    q = int(max(4, min(16, math.floor(math.sqrt(4500 / 25)))))
    for c, x in xs.items():
        dx = np.concatenate([np.diff(g["value"]) for _, g in rows[rows.channel == c].groupby("mid")])
        lo, hi = np.quantile(x, [5e-4, 1 - 5e-4])
        most = np.quantile(np.abs(dx), 0.999)
        assert (got[c].n, got[c].n_dx, got[c].problem) == (len(x), len(dx), None)
        assert np.allclose(got[c].amplitude, numpy_edges(x, fd(x, len(x), lo, hi), lo, hi, 0.25 * sigma(x)))
        assert np.allclose(got[c].increment, numpy_edges(dx, fd(dx, len(dx), -most, most), -most, most, 0.25 * sigma(dx)))
        assert np.allclose(got[c].coupling, numpy_edges(x, q, lo, hi, max(1e-9, 0.25 * sigma(x))))
    long = contract.long_edges(contract.contract(s))
    assert long.where("kind = 'amplitude' and channel = 'a'").count() == len(got["a"].amplitude)


def test_contract_problems(spark):
    rng = np.random.default_rng(2)
    s = table(spark, few=rng.normal(size=100), flat=np.full(5000, 1.0), fine=rng.normal(size=5000))
    got = {r.channel: r.problem for r in contract.contract(s, strict=False).collect()}
    assert got == {"few": "few_samples", "flat": "no_support", "fine": None}
    with pytest.raises(contract.ContractError, match="few_samples"):
        contract.contract(s.where("channel <> 'flat'"))
    single = s.where("channel = 'fine'").withColumn("mid", F.col("idx"))
    assert contract.contract(single, strict=False).first().problem == "few_increments"


def test_movement(spark):
    edges = spark.createDataFrame([("c", [-1.0, 0.0, 1.0])], "channel string, edges array<double>")
    rows = [(1, "c", 0, 5.0), (1, "c", 1, 5.0), (1, "c", 2, 2.0), (1, "c", 3, 3.0), (2, "c", 0, 4.0)]
    got = states.movement_pmf(spark.createDataFrame(rows, SCHEMA), edges).orderBy("mid", "bin").collect()
    assert [(r.mid, r.bin, r.prob, r.bin_left) for r in got] == [(1, 0, 1 / 3, -1.0), (1, 1, 2 / 3, 0.0), (2, 0, 1.0, -1.0), (2, 1, 0.0, 0.0)]


def test_joint_counts_shuffle_no_sample(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    wide = spark.createDataFrame(pd.DataFrame({"mid": np.arange(400) % 2, "idx": range(400), "a": x, "b": x + rng.normal(size=400), "c": 1.0}))
    edges = spark.createDataFrame([(c, [-9.0, -0.5, 0.5, 9.0]) for c in "abc"], "channel string, edges array<double>")
    joint = states.joint_counts(wide, edges, ["a", "b", "c"])
    for r in joint.collect():
        part = wide.toPandas().query(f"mid == {r.mid}")
        cell = {c: np.clip(np.searchsorted([-9, -0.5, 0.5, 9], part[c], side="right") - 1, 0, 2) for c in "abc"}
        assert r.k == ((cell[r.channel_i] == r.bi) & (cell[r.channel_j] == r.bj)).sum()
    assert joint.agg(F.sum("k")).first()[0] == 400 * 3
    plan = joint._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange")[1].strip().startswith("hashpartitioning(mid") and "partial_count" in plan
    mi = {(r.mid, r.channel_i, r.channel_j): r for r in states.mutual_information(joint).collect()}
    assert all(r.u_j == 0 and abs(r.mi) < 1e-9 for k, r in mi.items() if k[2] == "c")
    r = mi[0, "a", "b"]
    assert np.isclose(r.mi, r.h_i - r.h_cond) and np.isclose(r.u_i, r.mi / r.h_i) and 0 < r.u_i < 1

"""Steps that hold no more per task as the table grows, and shuffle each sample once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import scalars as S
from tessera.operators import bins, relational, states
from tessera.plans import views

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sample_limits_are_broadcast(spark, no_auto_broadcast):
    rows = spark.range(100).select(F.lit("c").alias("channel"), F.col("id").alias("idx"))
    assert "SortMergeJoin" not in plan(relational.sampled(rows, 5, ["channel"], ["idx"]))


@pytest.mark.parametrize("name", ["joint_counts", "mutual_information", "uncertainty", "capped_sample", "sampled_channels"])
def test_measurements_are_dealt_by_samples(spark, monkeypatch, name):
    monkeypatch.setattr(views, "EVEN", 100, raising=False)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 100)
    assert f"{n}), REPARTITION_BY_NUM" in plan(catalog.QUERIES[name](spark, DATA))


def test_joint_groups_have_one_number_for_channels_and_bins(spark):
    wide = spark.createDataFrame([(1, 0.5, 1.5, 9.0), (1, 0.5, 2.5, 9.0), (1, 0.5, 2.5, 9.0)], "mid int, b double, a double, c double")
    edges = spark.createDataFrame([(c, [0.0, 1.0, 2.0, 3.0]) for c in "abc"], "channel string, edges array<double>")
    joint = states.joint_counts(wide, edges, ["b", "a", "c"])
    assert sorted(map(tuple, joint.collect())) == [(1, "a", "b", 1, 0, 1), (1, "a", "b", 2, 0, 2), (1, "a", "c", 1, 2, 1), (1, "a", "c", 2, 2, 2), (1, "b", "c", 0, 2, 3)]
    assert "keys=[mid" in plan(joint) and "keys=[mid#" in plan(joint) and "channel_i" not in plan(joint).split("keys=[")[1].split("]")[0]


def test_files_are_ranked_where_they_are(spark, no_auto_broadcast):
    rows = spark.range(400).select((F.col("id") % 7).alias("mid"), F.lit("c").alias("channel"), F.col("id").alias("idx")).repartition(3, "mid")
    got = relational.capped_sample(rows, 5, 20, ["mid", "channel"], ["channel"], ["mid", "idx"])
    assert "SortMergeJoin" not in plan(got) and plan(got).count("Exchange hashpartitioning(mid") <= 2  # the rows' own, once for counts and once for rows
    assert got.count() == 20


def test_steps_of_all_channels_by_one_window(spark):
    rng = np.random.default_rng(3)
    rows = [(m, i, None if rng.random() < 0.2 else float(rng.integers(9)), float(rng.integers(9))) for m in range(4) for i in range(m * 9 + 1)]
    wide = spark.createDataFrame(rows, "mid int, idx int, a double, b double").repartition(5)
    one = bins.steps(wide, ["a", "b"])
    assert plan(one).count("Window [") == 1
    every = bins.increments(wide.unpivot(["mid", "idx"], ["a", "b"], "channel", "value"))
    assert sorted(map(tuple, one.where("value is not null").collect())) == sorted((r.mid, r.channel, r.value) for r in every.collect())
    assert one.count() == 2 * len(rows)


@pytest.mark.parametrize("n", [2, 3, 31, 32, 33, 257, 511, 512, 700])
def test_bins_are_found_by_halves(spark, n):
    rng = np.random.default_rng(n)
    edges = np.cumsum(rng.random(n))
    x = np.concatenate([edges, rng.random(60) * (edges[-1] + 1) - 0.5])
    rows = spark.createDataFrame([(float(v),) for v in x] + [(float("nan"),), (None,)], "x double").coalesce(1)
    at = S.bin_index(F.array(*[F.lit(float(e)) for e in edges]), F.col("x"))
    got = [r[0] for r in rows.select(at).collect()]
    assert got == [*np.clip(np.searchsorted(edges, x, side="right") - 1, 0, n - 2), n - 2, 0]
    if n == 257:
        assert "filter(" not in at._jc.toString().split("512")[0]

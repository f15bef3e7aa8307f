"""Small helpers of the levels: projections, orders, names, manifests, expected columns, and the profile run under a policy."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.config import ConfigError, ProfilePolicy
from tessera.operators import profiles, relational


def test_of_feature(spark):
    name = next(iter(relational.FEATURES))
    rows = spark.createDataFrame([(f" {s.upper()} ", i) for i, s in enumerate(relational.FEATURES[name])] + [("other", 99), (None, 98)], "feature string, k int")
    assert {r.k for r in relational.of_feature(rows, name).collect()} == set(range(len(relational.FEATURES[name])))
    assert [r.k for r in relational.of_feature(rows, "other").collect()] == [99]


def test_sorted_by(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "c"), (2, "a"), (None, "d")], "x int, y string")
    assert [r.y for r in relational.sorted_by(rows, ["none", "x", "y"]).collect()] == ["d", "c", "a", "b"]
    assert relational.sorted_by(rows, ["none"]).count() == 4


def test_manifest_and_names(spark):
    plan = spark.createDataFrame([("01Ene24", "UNK", "L1", None, "LB", 3)], "date string, group string, lab string, color string, label string, archivo int")
    assert tuple(relational.to_manifest(plan).first()) == ("01Ene24", "UNK", "L1", None, "UNK", "LB", 3)
    files = spark.createDataFrame([("d", "L", n) for n in "dbca"] + [("d", "L", "a"), ("d", "M", None), (None, "L", "z")], "date string, lab string, name string")
    got = {(r.date, r.lab): (r.n, r.names) for r in relational.listed_names(files, 2).collect()}
    assert got == {("d", "L"): (5, "a, b"), ("d", "M"): (1, ""), (None, "L"): (1, "z")}
    assert relational.listed_names(files.limit(0)).count() == 0
    assert spark.range(1).select(relational.month_root(F.lit(datetime.date(2026, 3, 4)))).first()[0] == "Mar26"


def test_expected_schema(spark):
    rows = [("p", 3, "Ch9"), ("p", 0, "t_rel"), ("p", 1, "t_sys"), ("p", 2, "Ch1"), ("p", 4, None), ("q", 0, None)]
    got = relational.expected_schema(spark.createDataFrame(rows, "path string, i int, role string")).collect()
    assert [(r.path, r["columns"]) for r in got] == [("p", ["t_sys", "t_rel", "Laser_1", "Laser_2"])]


def test_profile_run(spark):
    rows = [(f, "L", str(m), i, float((m * i + ord(f)) % 7 + i)) for f in "ab" for m in range(3) for i in (1, 2)] + [("a", "L", "9", 1, 5.0), ("a", "L", "8", 1, None)]
    run = profiles.profile_run(spark.createDataFrame(rows, "fecha string, lab string, mid string, laser int, v double"), ProfilePolicy("median", "spearman", 2, 3))
    assert run["base"].count() == 12 and run["means"].count() == 4 and run["dates"].count() == 1 and run["labs"].count() == 0 and run["matrix"].count() == 8
    middle = sorted(r[4] for r in rows[:6] if r[3] == 1)[1]
    assert run["means"].where("fecha = 'a' and laser = 1").first().block_v == middle
    assert all(r.valid for r in run["summary"].collect()) and run["overall"].count() == 2 and run["profiles"].count() == 6
    with pytest.raises(ConfigError):
        profiles.profile_run(run["base"], ProfilePolicy(min_measurements=0))
